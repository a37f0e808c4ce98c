"""Search listings and paper pages to records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import label
from paperloom.functions.urls import SITE, absolute_url, arxiv_id, listing_url
from paperloom.operators.lookup import lookup, prefilter
from paperloom.operators.select import Rule, attribute, find, find_by_priority, find_nested, text_of
from paperloom.schemas import EXPORT_FIELDS
from paperloom.sources.durable import cut_lineage
from paperloom.sources.html import parse_html

# Pages of one search that one task numbers.
CHUNK_PAGES = 1_000

# Markup of a search result and of a paper page.
RESULT_BLOCK = Rule("div", class_attr="flex w-full gap-6")
RESULT_STEPS = (
    Rule("h3", class_attr="mb-3 text-lg/6 font-semibold hover:underline peer-hover:underline 2xl:text-[1.2rem]/6"),
    Rule("a", class_attr="line-clamp-3 cursor-pointer text-balance"),
)
TITLE_RULES = (
    Rule("h1", attrs={"data-testid": "paper-title"}),
    Rule("h1", classes=("title",)),
    Rule("h1"),
    Rule(classes=("paper-title",)),
    Rule(attrs={"data-testid": "paper-title"}),
)
SUMMARY_RULE = Rule("p", classes=("text-blue-700", "dark:text-blue-400"))
ABSTRACT_RULE = Rule("p", classes=("text-gray-600",))
PDF_RULE = Rule("a", classes=("btn", "inline-flex", "h-9", "items-center"))


@dataclass(frozen=True)
class PaperRules:
    """Where a paper page keeps its fields."""

    title: Sequence[Rule] = TITLE_RULES
    summary: Rule = SUMMARY_RULE
    abstract: Rule = ABSTRACT_RULE
    pdf: Rule = PDF_RULE

    def all(self) -> list[Rule]:
        return [*self.title, self.summary, self.abstract, self.pdf]


def listing_links(
    pages: DataFrame,
    n: int | Column,
    block: Rule = RESULT_BLOCK,
    steps: Sequence[Rule] = RESULT_STEPS,
    site: str = SITE,
) -> DataFrame:
    """First ``n`` result links of each search, numbered from 1.

    ``pages(search_id, page_ord, html)`` in, ``(search_id, ord, url)`` out. ``n``
    may be a column of the pages with one value per search. A block without a
    link does not count against ``n``; repeated links stay.

    A page keeps at most ``n`` links. They are numbered in two levels: links per
    chunk of ``CHUNK_PAGES`` consecutive pages are summed over chunks, and pages
    within their chunk. So no task sorts a whole search, whatever ``n`` is. Pages
    without a number stand in front, in chunks by hash.
    """
    limit = F.greatest(n if isinstance(n, Column) else F.lit(n), F.lit(0)).cast("int")
    read = pages.where(F.col("html").isNotNull()).select("search_id", "page_ord", "html", limit.alias("_limit"))
    parsed = parse_html(read, [block, *steps], texts=False)
    links = F.transform(
        find_nested(F.col("nodes"), block, steps), lambda element: attribute(element, "href")
    )
    kept = F.filter(links, lambda href: href.isNotNull() & (href != ""))
    cut = parsed.select("search_id", "page_ord", "_limit", F.slice(kept, 1, F.col("_limit")).alias("_links"))
    written = cut_lineage(cut.where(F.size("_links") > 0), "links")
    hashed = F.pmod(F.xxhash64("_links"), F.lit(1 << 10)) - (1 << 62)
    placed = written.select(
        "*",
        F.coalesce(F.expr(f"page_ord div {CHUNK_PAGES}"), hashed).alias("_chunk"),
        F.size("_links").cast("bigint").alias("_n"),
    )
    chunks = Window.partitionBy("search_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("search_id", "_chunk").agg(F.sum("_n").alias("_sum"))
    before = sums.select(
        F.col("search_id").alias("_search"),
        F.col("_chunk").alias("_at"),
        F.coalesce(F.sum("_sum").over(chunks), F.lit(0)).alias("_before"),
    )
    same = F.col("search_id").eqNullSafe(F.col("_search")) & (F.col("_chunk") == F.col("_at"))
    within = Window.partitionBy("search_id", "_chunk").orderBy("page_ord", F.xxhash64("_links"))
    earlier = F.coalesce(F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = placed.join(before, same).where("_before < _limit").withColumn("_offset", F.col("_before") + earlier)
    numbered = offset.select("search_id", "_limit", "_offset", F.posexplode("_links").alias("pos", "href"))
    return (
        numbered.withColumn("ord", (F.col("_offset") + F.col("pos") + 1).cast("int"))
        .where(F.col("ord") <= F.col("_limit"))
        .select("search_id", "ord", listing_url(F.col("href"), site).alias("url"))
    )


def paper_records(
    pages: DataFrame, key: str = "page_id", rules: PaperRules = PaperRules(), site: str = SITE, sep: str = ""
) -> DataFrame:
    """One record per page; pages without html keep their url and get an error.

    ``pages(key, url, html)`` in, ``key`` and the record columns out. No
    shuffle: a page is parsed and read within its row.
    """
    nodes = F.col("nodes")
    source = pages.select(key, "url", "html")
    parsed = parse_html(source, rules.all())
    elements = parsed.select(
        key,
        "url",
        "nodes",
        "parse_error",
        find_by_priority(nodes, rules.title).alias("_title"),
        find(nodes, rules.summary).alias("_summary"),
        find(nodes, rules.abstract).alias("_abstract"),
        find(nodes, rules.pdf).alias("_pdf"),
    )
    failed = nodes.isNull()

    def unless_failed(value: Column) -> Column:
        return F.when(~failed, value)

    return elements.select(
        key,
        "url",
        unless_failed(text_of(nodes, F.col("_title"), sep)).alias("title"),
        unless_failed(text_of(nodes, F.col("_summary"), sep)).alias("llm_summary"),
        unless_failed(text_of(nodes, F.col("_abstract"), sep)).alias("abstract"),
        unless_failed(absolute_url(attribute(F.col("_pdf"), "href"), site)).alias("pdf_url"),
        unless_failed(arxiv_id(F.col("url"))).alias("arxiv_id"),
        F.when(failed, F.coalesce("parse_error", F.lit("no page content"))).alias("error"),
    )


def records_for_links(links: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """Records of listed links, in listing order, one per link.

    A link with no page becomes an error record. Only linked pages are parsed;
    a filter of the listed links at the scan keeps most others out of the count
    and the shuffle. Of several pages with one url the first counts, chosen among the records,
    which are small, not among the pages.
    """
    urls = links.select("url").distinct()
    linked = lookup(prefilter(pages, urls, "url"), urls, "url", spread_by=["page_id"], how="left_semi")
    records = paper_records(linked, **options)
    fields = [name for name in records.columns if name not in ("page_id", "url")]
    first = records.groupBy("url").agg(F.min_by(F.struct(*fields), "page_id").alias("record"))
    found = lookup(links, first, "url", spread_by=["search_id", "ord"])
    missing = F.when(F.col("record").isNull(), F.lit("page not found"))
    return found.select(
        "search_id",
        "ord",
        "url",
        *[F.col(f"record.{name}").alias(name) for name in fields if name != "error"],
        F.coalesce(missing, F.col("record.error")).alias("error"),
    )


def union_records(good: DataFrame, failed: DataFrame) -> DataFrame:
    """Good and failed records as one table with the columns of both."""
    return good.unionByName(failed, allowMissingColumns=True)


def without_errors(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("error").isNull())


def export_papers(papers: DataFrame) -> DataFrame:
    """The six export columns of good records, NULL as the empty string."""
    return without_errors(papers).select(*EXPORT_FIELDS).na.fill("")


def fill_selected(papers: DataFrame, columns: Sequence[str] = ("llm_summary", "abstract")) -> DataFrame:
    """NULL as the empty string in the named text columns, if there; others stay as they are."""
    return papers.na.fill("", subset=[name for name in columns if name in papers.columns])


def clean_nulls(papers: DataFrame) -> DataFrame:
    """Every column as text, NULL as the empty string."""
    return papers.select([F.col(name).cast("string").alias(name) for name in papers.columns]).na.fill("")


def basic_columns(papers: DataFrame) -> DataFrame:
    """Title and url if both exist, else the first two columns; no NULLs."""
    wanted = ["title", "url"]
    names = wanted if set(wanted) <= set(papers.columns) else papers.columns[:2]
    return clean_nulls(papers.select(*names))


def run_counts(papers: DataFrame) -> DataFrame:
    """How many papers a run holds and how many came out well."""
    return papers.agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_if(F.col("error").isNull()).alias("crawled"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def preview_text(papers: DataFrame) -> Column:
    """First 60 characters of the translation if there is one, else of the abstract."""
    if "abstract_translate" in papers.columns:
        return F.substring(F.coalesce("abstract_translate", "abstract"), 1, 60)
    return F.substring("abstract", 1, 60)


def preview(papers: DataFrame, rows: int = 2, order: str = "ord") -> DataFrame:
    """Short form of the first rows: cut title and abstract, and whichever of
    category, year, positive citation count and PDF path the papers have."""
    shown = {
        "title": label(F.col("title"), 50),
        "abstract": label(preview_text(papers), 60),
        "category": F.col("category"),
        "Year": F.col("Year"),
        "Citation_Count": F.when(F.col("Citation_Count") > 0, F.col("Citation_Count")),
        "pdf_path": F.col("pdf_path"),
    }
    columns = [value.alias(name) for name, value in shown.items() if name in papers.columns]
    return papers.orderBy(order).limit(rows).select(order, *columns)
