"""Links, file names and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import safe_title

# The site whose listing and paper pages are read.
SITE = "https://huggingface.co"
SEARCH_PAGE = "https://huggingface.co/papers/trending"

# Fixed value: the download folder.
PDF_ROOT = "pdfs"


def form_encode(value: Column) -> Column:
    """Form encoding in which ``~`` stays and ``*`` is escaped."""
    encoded = F.url_encode(value)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_url(words: Column, base: str = SEARCH_PAGE) -> Column:
    """Search address; the joining ``+`` is itself escaped."""
    return F.concat(F.lit(base + "?q="), form_encode(F.array_join(words, "+")))


def listing_url(href: Column, site: str = SITE) -> Column:
    return F.concat(F.lit(site), href)


def absolute_url(href: Column, site: str = SITE) -> Column:
    """Links starting with ``http`` stay, others get the site in front; a
    missing or empty link gives the empty string."""
    link = F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href))
    return F.when(F.coalesce(href, F.lit("")) == "", F.lit("")).otherwise(link)


def arxiv_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"/papers/(\p{Nd}+\.\p{Nd}+)", 1)
    return F.coalesce(found, F.lit(""))


def is_arxiv(url: Column) -> Column:
    on_site = url.contains("arxiv.org")
    return F.coalesce(on_site & (url.contains("/abs/") | url.contains("/pdf/")), F.lit(False))


def pdf_url(url: Column) -> Column:
    """Address of the PDF behind an abstract or PDF link."""
    from_abstract = F.concat(F.replace(url, F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf"))
    return (
        F.when(~url.contains("arxiv.org"), url)
        .when(url.contains("/abs/"), from_abstract)
        .when(url.contains("/pdf/") & ~url.endswith(".pdf"), F.concat(url, F.lit(".pdf")))
        .otherwise(url)
    )


def pdf_filename(url: Column, title: Column) -> Column:
    """File name from a ``/pdf/`` link, else from the title."""
    from_url = F.concat(
        F.replace(F.substring_index(url, "/pdf/", -1), F.lit(".pdf"), F.lit("")), F.lit(".pdf")
    )
    from_title = F.concat(safe_title(title), F.lit(".pdf"))
    return (
        F.when(url.contains("/pdf/"), from_url)
        .when(F.coalesce(title, F.lit("")) != "", from_title)
        .otherwise(F.lit("paper.pdf"))
    )


def pdf_folder(words: Column) -> Column:
    return F.concat(F.lit(PDF_ROOT + "/"), F.replace(F.array_join(words, "_"), F.lit(" "), F.lit("_")))


def pdf_path(words: Column, filename: Column) -> Column:
    return F.concat(pdf_folder(words), F.lit("/"), filename)


def split_words(text: Column) -> Column:
    """Words of a search string, cut at white space."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda word: word != "")


def papers_file_name(words: Column) -> Column:
    return F.concat(F.lit("papers_"), F.array_join(words, "_"), F.lit(".csv"))


def translated_file_name(base: Column, language: Column) -> Column:
    suffix = F.replace(language, F.lit("-"), F.lit("_"))
    return F.concat(base, F.lit("_translated_"), suffix, F.lit(".csv"))


def classified_file_name(base: Column) -> Column:
    return F.concat(base, F.lit("_classified.csv"))


def qa_file_name(folder: Column, stamp: Column) -> Column:
    """``stamp`` is a timestamp; without a folder the name says ``results``."""
    name = F.coalesce(F.nullif(folder, F.lit("")), F.lit("results"))
    return F.concat(
        F.lit("paper_qa_"), name, F.lit("_"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit(".csv")
    )
