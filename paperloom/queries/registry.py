"""Every query by name, with its SQL where SQL can say it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.queries import views as V
from paperloom.functions import answers as A
from paperloom.functions import prompts as P
from paperloom.functions import text as X
from paperloom.functions import urls as U
from paperloom.functions.languages import LANGUAGE_NAMES, language_name
from paperloom.operators import batches, enrich, metadata, passages, pdfs, qa, records, titles, topics
from paperloom.operators.answer_store import AnswerStore
from paperloom.operators.select import Rule, find, find_by_priority, find_nested, attribute, text_of
from paperloom.plans import csv_jobs
from paperloom.plans.crawl import CrawlOptions, paper_table
from paperloom.plans.paper_qa import answer_table
from paperloom.sources.durable import new_path
from paperloom.sources.files import read_papers, read_split_papers, spread, write_papers
from paperloom.sources.html import node_rows, parse_html


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, needs: tuple[str, ...] = ()):
    def register(run):
        QUERIES[run.__name__] = Query(run, None if sql is None else V.with_views(needs, sql))
        return run

    return register


# --- services standing in for the caller's --------------------------------


def md5_service():
    """Answers with the MD5 of what it is asked."""
    return lambda text: hashlib.md5(text.encode()).hexdigest()


def translation_service():
    """Two segments which together are the MD5 of the text."""

    def send(text: str) -> str:
        digest = hashlib.md5(text.encode()).hexdigest()
        return json.dumps([[[digest[:10], "a"], ["", "b"], [digest[10:], "c"]], None, "xx"])

    return send


def echo_service():
    """Answers with the MD5 of what it is asked, and what else it was told."""

    def send(text: str, language: str = "none", max_tokens: int = 0) -> str:
        return f"{hashlib.md5(text.encode()).hexdigest()}|{language}|{max_tokens}"

    return send


def grouping_service():
    """Groups the titles of a batch prompt by MD5; leaves out group 0."""

    def send(prompt: str) -> str:
        titles = re.findall(r"^Title: (.*)\nSummary: ", prompt, flags=re.MULTILINE)
        groups = {title: hashlib.md5(title.encode()).hexdigest()[0] for title in titles}
        named = {title: group for title, group in groups.items() if group != "0"}
        reply = {"categories": {group: "by digest" for group in groups.values()}, "classifications": named}
        return "Done.\n```json\n" + json.dumps(reply) + "\n```"

    return send


def naming_service():
    """Gives each title of a batch prompt a group of its own digits, and merges groups by the first one."""

    def send(prompt: str) -> str:
        titles = re.findall(r"^Title: (.*)\nSummary: ", prompt, flags=re.MULTILINE)
        named = {title: hashlib.md5(title.encode()).hexdigest()[:2] for title in titles}
        merged: dict[str, list[str]] = {}
        for name in re.findall(r"^- (\w+): ", prompt, flags=re.MULTILINE):
            merged.setdefault(name[0], []).append(name)
        return json.dumps({"merged": merged, "categories": {}, "classifications": named})

    return send


def half_service():
    """Answers texts whose MD5 begins with a digit below 8, and fails for the others."""

    def send(text: str) -> str:
        digest = hashlib.md5(text.encode()).hexdigest()
        if digest[0] >= "8":
            raise RuntimeError("down")
        return digest

    return send


def marked_service():
    """Answers with the MD5 of what it is asked and a mark."""
    return lambda text: hashlib.md5(text.encode()).hexdigest() + "!"


# --- pages -----------------------------------------------------------------

H1, AD, FOOTER, LINK, ITEM = Rule("h1"), Rule("div", classes=("ad",)), Rule("footer"), Rule("a"), Rule("li")
PAGE_RULES = records.PaperRules(title=(H1,), summary=AD, abstract=FOOTER, pdf=LINK)
HOST = r"^https?://([^/?#:]*)"

_H1 = V.sql_text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")
_AD = V.sql_text("""regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)""")
_FOOTER = V.sql_text("regexp_extract(html, '<footer>([^<]*)', 1)")
_A = V.sql_text("regexp_extract(html, '<a [^>]*>([^<]*)</a>', 1)")
_HREF = """regexp_extract(html, '<a href="([^"]*)"', 1)"""
_SITE = f"'{U.SITE}'"


def _pages(spark, sf_dir):
    return spread(V.pages(spark, sf_dir).select("page_id", "url", "html"), "page_id")


def _record_pages(spark, sf_dir):
    return _pages(spark, sf_dir).withColumn("url", V.paper_url())


@query()
def html_nodes(spark, sf_dir):
    return node_rows(parse_html(_pages(spark, sf_dir)), "page_id").select(
        "page_id", "pos", "end_pos", "tag", "class_attr", "text", "container"
    )


@query(
    """select page_id, tag, count(*) as n
       from (select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[\\s>/]', 1)) as tag from pages)
       group by page_id, tag"""
)
def html_tag_counts(spark, sf_dir):
    parsed = parse_html(_pages(spark, sf_dir), texts=False)
    tags = F.filter(F.col("nodes.tag"), lambda tag: tag.isNotNull())
    return parsed.select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    f"""select page_id, 'h1' as rule, {_H1} as text from pages
        union all select page_id, 'a', {_A} from pages
        union all select page_id, 'div.ad', {_AD} from pages
        union all select page_id, 'footer', {_FOOTER} from pages"""
)
def first_match(spark, sf_dir):
    rules = {"h1": H1, "a": LINK, "div.ad": AD, "footer": FOOTER}
    nodes = F.col("nodes")
    parsed = parse_html(_pages(spark, sf_dir), list(rules.values()))
    found = parsed.select(
        "page_id", "nodes", *[find(nodes, rule).alias(f"_{place}") for place, rule in enumerate(rules.values())]
    )
    rows = [
        F.struct(F.lit(name).alias("rule"), text_of(nodes, F.col(f"_{place}")).alias("text"))
        for place, name in enumerate(rules)
    ]
    return found.select("page_id", F.inline(F.array(*rows)))


@query(f"select page_id, {_H1} as title from pages")
def title_by_priority(spark, sf_dir):
    rules = [Rule("h1", classes=("title",)), H1, Rule("title")]
    parsed = parse_html(_pages(spark, sf_dir), rules)
    found = parsed.select("page_id", "nodes", find_by_priority(F.col("nodes"), rules).alias("_title"))
    return found.select("page_id", text_of(F.col("nodes"), F.col("_title")).alias("title"))


@query("""select page_id, regexp_extract(html, '<ul><li><a href="([^"]*)"', 1) as href from pages""")
def nested_select(spark, sf_dir):
    rules = [Rule("ul"), ITEM, LINK]
    parsed = parse_html(_pages(spark, sf_dir), rules, texts=False)
    links = find_nested(F.col("nodes"), rules[0], rules[1:])
    return parsed.select("page_id", F.explode(links).alias("link")).select(
        "page_id", attribute(F.col("link"), "href").alias("href")
    )


def _listing(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        F.regexp_extract("url", HOST, 1).alias("search_id"), F.col("page_id").alias("page_ord"), "html"
    )


_ALL_LISTED = f"""
    select search_id, cast(ord as int) as ord, concat({_SITE}, href) as url
    from (select search_id, href, row_number() over (partition by search_id order by page_id, pos) as ord
      from (select regexp_extract(url, '{HOST}', 1) as search_id, page_id, unnest(hrefs) as href,
              generate_subscripts(hrefs, 1) as pos
            from (select *, regexp_extract_all(html, '<li><a href="([^"]+)"', 1) as hrefs from pages)))"""
_LISTING_SQL = f"{_ALL_LISTED} where ord <= 3"


@query(_LISTING_SQL)
def listing_links(spark, sf_dir):
    return records.listing_links(_listing(spark, sf_dir), 3, ITEM, [LINK])


@query(f"{_ALL_LISTED} where ord <= 1000 * length(search_id)")
def listing_links_by_search(spark, sf_dir):
    return records.listing_links(_listing(spark, sf_dir), 1000 * F.length("search_id"), ITEM, [LINK])


_RECORD_SQL = f"""
    select p.page_id, v.url, {_H1} as title, {_AD} as llm_summary, {_FOOTER} as abstract,
      concat({_SITE}, {_HREF}) as pdf_url, regexp_extract(v.url, '/papers/(\\d+\\.\\d+)', 1) as arxiv_id,
      cast(null as varchar) as error
    from pages p join page_papers v on p.page_id = v.page_id"""


@query(_RECORD_SQL, ("page_papers",))
def paper_records(spark, sf_dir):
    return records.paper_records(_record_pages(spark, sf_dir), rules=PAGE_RULES)


@query(
    f"select title, llm_summary, abstract, pdf_url, arxiv_id, url from ({_RECORD_SQL})",
    ("page_papers",),
)
def export_papers(spark, sf_dir):
    return records.export_papers(paper_records(spark, sf_dir))


@query(f"select page_id, concat({_SITE}, {_HREF}) as pdf_url from pages")
def absolute_links(spark, sf_dir):
    parsed = parse_html(_pages(spark, sf_dir), [LINK], texts=False)
    href = attribute(find(F.col("nodes"), LINK), "href")
    return parsed.select("page_id", U.absolute_url(href).alias("pdf_url"))


@query(
    f"""select l.search_id, l.ord, l.url, r.title, r.llm_summary, r.abstract, r.pdf_url, r.arxiv_id,
          case when r.url is null then 'page not found' end as error,
          case when coalesce(r.abstract, '') = '' then '' else md5(r.abstract) end as abstract_translate
        from ({_LISTING_SQL}) l left join (
          select concat({_SITE}, {_HREF}) as url, {_H1} as title, {_AD} as llm_summary, {_FOOTER} as abstract,
            concat({_SITE}, {_HREF}) as pdf_url, '' as arxiv_id
          from pages
          where page_id in (select min(page_id) from pages group by {_HREF})) r on l.url = r.url"""
)
def crawl_papers(spark, sf_dir):
    first_link = F.concat(F.lit(U.SITE), F.regexp_extract("html", '<a href="([^"]*)"', 1))
    options = CrawlOptions(n=3, block=ITEM, steps=(LINK,), rules=PAGE_RULES, translate=translation_service)
    return paper_table(_listing(spark, sf_dir), _pages(spark, sf_dir).withColumn("url", first_link), options)


# --- records ---------------------------------------------------------------


@query(
    """select ord, title, abstract, cast(null as varchar) as error from doc_papers where error is null
       union all select ord, null, null, error from doc_papers where error is not null""",
    ("doc_papers",),
)
def records_with_errors(spark, sf_dir):
    papers = V.doc_papers(spark, sf_dir)
    good = records.without_errors(papers).select("ord", "title", "abstract")
    failed = papers.where(F.col("error").isNotNull()).select("ord", "error")
    return records.union_records(good, failed)


@query("select * from doc_papers where error is null", ("doc_papers",))
def records_ok(spark, sf_dir):
    return records.without_errors(V.doc_papers(spark, sf_dir))


@query(
    """select ord, search_key, lang, title, coalesce(llm_summary, '') as llm_summary,
         coalesce(abstract, '') as abstract, error from doc_papers""",
    ("doc_papers",),
)
def fill_selected(spark, sf_dir):
    return records.fill_selected(V.doc_papers(spark, sf_dir))


_CLEAN = "select cast(ord as varchar) as ord, " + ", ".join(
    f"coalesce({name}, '') as {name}" for name in ("search_key", "lang", "title", "llm_summary", "abstract", "error")
)


@query(f"{_CLEAN} from doc_papers", ("doc_papers",))
def clean_nulls(spark, sf_dir):
    return records.clean_nulls(V.doc_papers(spark, sf_dir))


@query("select cast(ord as varchar) as ord, search_key from doc_papers", ("doc_papers",))
def basic_projection(spark, sf_dir):
    return records.basic_columns(V.doc_papers(spark, sf_dir))


@query("select title, url from page_papers", ("page_papers",))
def basic_title_url(spark, sf_dir):
    return records.basic_columns(V.page_papers(spark, sf_dir))


@query(f"select ord, abstract from doc_papers where not {V.sql_blank('abstract')}", ("doc_papers",))
def nonblank_abstracts(spark, sf_dir):
    return V.doc_papers(spark, sf_dir).where(X.not_blank(F.col("abstract"))).select("ord", "abstract")


@query(f"select ord, llm_summary from doc_papers where not {V.sql_blank('llm_summary')}", ("doc_papers",))
def nonblank_summaries(spark, sf_dir):
    return V.doc_papers(spark, sf_dir).where(X.not_blank(F.col("llm_summary"))).select("ord", "llm_summary")


@query(
    """select ord, substr(coalesce(llm_summary, abstract), 1, 60) as preview,
         case when length(title) > 80 then substr(title, 1, 80) || '...' else title end as short_title
       from doc_papers""",
    ("doc_papers",),
)
def preview_text(spark, sf_dir):
    papers = V.doc_papers(spark, sf_dir).withColumnRenamed("llm_summary", "abstract_translate")
    return papers.select(
        "ord", records.preview_text(papers).alias("preview"), X.shorten(F.col("title"), 80).alias("short_title")
    )


@query(
    """select ord, substr(coalesce(title, ''), 1, 50) || '...' as title,
         substr(coalesce(abstract, ''), 1, 60) || '...' as abstract, cast("Year" as double) as "Year",
         cast(nullif("Citation_Count", 0) as double) as "Citation_Count"
       from waterfall order by ord limit 2""",
    ("waterfall",),
)
def paper_preview(spark, sf_dir):
    papers = metadata.metadata_waterfall(V.doc_papers(spark, sf_dir), V.catalogs(spark, sf_dir))
    numbers = {name: F.col(name).cast("double") for name in ("Year", "Citation_Count")}
    return records.preview(papers.withColumns(numbers))


@query(
    """select count(*) as papers, count(*) filter (where error is null) as crawled,
         count(*) filter (where error is not null) as failed from doc_papers""",
    ("doc_papers",),
)
def run_counts(spark, sf_dir):
    return records.run_counts(V.doc_papers(spark, sf_dir))


@query(
    "select cast(ord as varchar) as ord, nullif(search_key, '') as search_key, lang, nullif(title, '') as title, "
    "nullif(llm_summary, '') as llm_summary, nullif(abstract, '') as abstract, error from doc_papers",
    ("doc_papers",),
)
def csv_roundtrip(spark, sf_dir):
    papers = V.doc_papers(spark, sf_dir)
    path = write_papers(papers, new_path(spark, "papers-csv"))
    return read_papers(spark, path, records.clean_nulls(papers).schema)


_FILE = """nullif(title, '') as title, nullif(llm_summary, '') as llm_summary, nullif(abstract, '') as abstract,
    cast(null as varchar) as pdf_url, cast(null as varchar) as arxiv_id, cast(null as varchar) as url, lang"""


def _paper_file(spark, sf_dir, *more):
    """A paper file with its columns in another order, and further ones."""
    return write_papers(
        V.doc_papers(spark, sf_dir).select("lang", "abstract", *more, "llm_summary", "title"), new_path(spark, "papers-csv")
    )


@query(f"select {_FILE}, cast(ord as varchar) as ord from doc_papers", ("doc_papers",))
def csv_other_order(spark, sf_dir):
    return read_papers(spark, _paper_file(spark, sf_dir, "ord"))


_LINES = """replace(replace(nullif(abstract, ''), '. ', '.' || chr(10)), ' the ', ' "the", ')"""


@query(f"select cast(ord as varchar) as ord, lang, nullif(title, '') as title, {_LINES} as abstract from doc_papers", ("doc_papers",))
def csv_split(spark, sf_dir):
    lines = F.replace(F.replace("abstract", F.lit(". "), F.lit(".\n")), F.lit(" the "), F.lit(' "the", '))
    papers = V.doc_papers(spark, sf_dir).withColumn("abstract", lines)
    path = write_papers(papers, new_path(spark, "papers-csv"))
    return read_split_papers(spark, path).select("ord", "lang", "title", "abstract")


@query(
    f"""select {_FILE}, cast(ord as varchar) as ord,
         case when not {V.sql_blank("abstract")} then md5(abstract) end as abstract_translate from doc_papers""",
    ("doc_papers",),
)
def csv_translated(spark, sf_dir):
    source = _paper_file(spark, sf_dir, "ord")
    return read_papers(spark, csv_jobs.translate_csv(spark, source, new_path(spark, "jobs"), translation_service))


@query(
    f"""select {_FILE}, case when n.named is null or substr(md5(title), 1, 1) = '0' then 'Unclassified'
         else substr(md5(title), 1, 1) end as category
       from doc_papers left join (select distinct title as named from doc_papers where not {V.sql_blank("llm_summary")}) n
         on title = n.named""",
    ("doc_papers",),
)
def csv_classified(spark, sf_dir):
    folder = new_path(spark, "jobs")
    done = csv_jobs.classify_csv(spark, _paper_file(spark, sf_dir), folder, grouping_service, V.SEARCH_WORDS)
    return read_papers(spark, done)


# --- names and links -------------------------------------------------------


@query(
    f"select concat('{U.SEARCH_PAGE}?q=', replace(url_encode(replace(p_name, ' ', '+')), '%20', '+')) as url, p_name "
    "from search_words",
    ("search_words",),
)
def search_urls(spark, sf_dir):
    words = V.search_words(spark, sf_dir)
    return words.select("p_name", U.search_url(U.split_words(F.col("p_name"))).alias("url"))


@query(
    """select p_name, concat('papers_', replace(p_name, ' ', '_'), '.csv') as papers_file,
         concat(p_name, '_translated_zh_cn.csv') as translated_file, concat(p_name, '_classified.csv') as classified_file,
         concat('paper_qa_', p_name, '_20240102_030405.csv') as qa_file
       from search_words""",
    ("search_words",),
)
def output_names(spark, sf_dir):
    name = F.col("p_name")
    return V.search_words(spark, sf_dir).select(
        "p_name",
        U.papers_file_name(U.split_words(name)).alias("papers_file"),
        U.translated_file_name(name, F.lit("zh-cn")).alias("translated_file"),
        U.classified_file_name(name).alias("classified_file"),
        U.qa_file_name(name, F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("qa_file"),
    )


@query("select ord, substr(cleaned, 1, 50) as safe_title from (select page_id as ord, cleaned from titles)", ("titles",))
def safe_titles(spark, sf_dir):
    papers = V.page_papers(spark, sf_dir)
    return papers.select(F.col("page_id").alias("ord"), X.safe_title(F.col("title")).alias("safe_title"))


@query("select page_id, url, regexp_extract(url, '/papers/(\\d+\\.\\d+)', 1) as arxiv_id from page_papers", ("page_papers",))
def arxiv_id(spark, sf_dir):
    return V.page_papers(spark, sf_dir).select("page_id", "url", U.arxiv_id(F.col("url")).alias("arxiv_id"))


@query("select page_id, pdf_url from targets where fetch_url is not null", ("targets",))
def arxiv_filter(spark, sf_dir):
    return V.page_papers(spark, sf_dir).where(U.is_arxiv(F.col("pdf_url"))).select("page_id", "pdf_url")


@query("select page_id, case when fetch_url is null then pdf_url else fetch_url end as pdf_url from targets", ("targets",))
def pdf_urls(spark, sf_dir):
    return V.page_papers(spark, sf_dir).select("page_id", U.pdf_url(F.col("pdf_url")).alias("pdf_url"))


@query("select page_id, pdf_path from targets", ("targets",))
def pdf_filenames(spark, sf_dir):
    return pdfs.target_paths(V.page_papers(spark, sf_dir), V.SEARCH_WORDS).select("page_id", "pdf_path")


_PLAN_COLUMNS = ["page_id", "pdf_url", "fetch_url", "pdf_path", "pdf_status", "pdf_conflict"]


@query("select * from pdf_plan", ("pdf_plan",))
def pdf_plan(spark, sf_dir):
    papers = V.page_papers(spark, sf_dir)
    return pdfs.pdf_plan(papers, V.SEARCH_WORDS, V.manifest(spark, sf_dir), ["page_id"]).select(_PLAN_COLUMNS)


@query(
    """select pdf_path, min(fetch_url) as fetch_url from targets
       where pdf_path is not null and pdf_path not in (select pdf_path from manifest) group by pdf_path""",
    ("targets", "manifest"),
)
def pdf_todo(spark, sf_dir):
    targets = pdfs.target_paths(V.page_papers(spark, sf_dir), V.SEARCH_WORDS)
    return pdfs.pdf_todo(targets, V.manifest(spark, sf_dir))


@query(
    """select pdf_path, count(*) as papers from targets
       where pdf_path in (select pdf_path from manifest) group by pdf_path""",
    ("targets", "manifest"),
)
def pdf_reused(spark, sf_dir):
    targets = pdfs.target_paths(V.page_papers(spark, sf_dir), V.SEARCH_WORDS)
    return pdfs.pdf_reused(targets, V.manifest(spark, sf_dir))


@query(
    """select count(pdf_path) as pdfs, count(*) filter (where pdf_status = 'fetch') as to_fetch,
         count(*) filter (where pdf_status = 'reuse') as reused, count(*) as papers from pdf_plan""",
    ("pdf_plan",),
)
def pdf_plan_summary(spark, sf_dir):
    return pdfs.pdf_summary(pdf_plan(spark, sf_dir))


_NAMES = " ".join(f"when '{code}' then '{name}'" for code, name in LANGUAGE_NAMES.items())


@query(f"select ord, lang, case lang {_NAMES} else upper(lang) end as language from doc_papers", ("doc_papers",))
def language_names(spark, sf_dir):
    return V.doc_papers(spark, sf_dir).select("ord", "lang", language_name(F.col("lang")).alias("language"))


# --- metadata --------------------------------------------------------------


@query(
    'select ord, title, cast("Year" as double) as "Year", "Citation_Count", "Metadata_Source" from waterfall',
    ("waterfall",),
)
def metadata_waterfall(spark, sf_dir):
    found = metadata.metadata_waterfall(V.doc_papers(spark, sf_dir), V.catalogs(spark, sf_dir))
    # Year as double: integers with gaps look different in Spark's and the SQL side's pandas frames.
    return found.select("ord", "title", F.col("Year").cast("double"), "Citation_Count", "Metadata_Source")


@query(
    """select count(*) filter (where "Metadata_Source" <> 'not_found') as found, count(*) as papers,
         round(avg(case when "Citation_Count" > 0 then "Citation_Count" end), 6) as avg_citations from waterfall""",
    ("waterfall",),
)
def metadata_summary(spark, sf_dir):
    summary = metadata.metadata_summary(metadata_waterfall(spark, sf_dir))
    return summary.withColumn("avg_citations", F.round("avg_citations", 6))


_MISSPELLED = """case p_partkey % 6 when 0 then p_name when 1 then replace(upper(p_name), ' ', ' - ')
  when 2 then concat(substr(p_name, 1, 4), substr(p_name, 6)) when 3 then concat(substr(p_name, 1, 6), 'q', substr(p_name, 8))
  when 4 then concat(substr(p_name, 1, 2), 'x', substr(p_name, 3, length(p_name) - 3)) else concat('zzz', p_name) end"""


@query(
    f"""with keyed as (
          select p_partkey as ord, trim(regexp_replace(lower({_MISSPELLED}), '[^a-z0-9]+', ' ', 'g')) as key from part),
        catalog as (
          select place, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as held, p_partkey,
            1990 + p_partkey % 30 as year, p_partkey % 50 as citations
          from part, (values (0), (1), (2)) s(place) where p_partkey % 4 <= place),
        held as (select place, held, min_by(year, p_partkey) as year, min_by(citations, p_partkey) as citations
          from catalog group by place, held),
        near as (
          select k.key, h.held, levenshtein(k.key, h.held) as distance
          from (select distinct key from keyed) k, (select distinct held from held) h
          where abs(length(k.key) - length(h.held)) <= 2
            and levenshtein(k.key, h.held) <= least(2, length(h.held) // 8)),
        hits as (
          select key, first({{'y': year, 'c': citations, 'p': place}} order by place, distance, n.held) as hit
          from near n join held h on n.held = h.held group by key)
        select ord, cast(hit.y as double) as "Year", cast(coalesce(hit.c, 0) as bigint) as "Citation_Count",
          case hit.p when 0 then 'semantic_scholar' when 1 then 'crossref' when 2 then 'openalex' else 'not_found' end
            as "Metadata_Source"
        from keyed left join hits using (key)"""
)
def metadata_titles(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    papers = part.select(F.col("p_partkey").alias("ord"), F.expr(_MISSPELLED).alias("title"))

    def catalog(place):
        year = (F.lit(1990) + F.col("p_partkey") % 30).alias("year")
        held = part.where(F.col("p_partkey") % 4 <= place)
        return held.select(
            F.col("p_name").alias("title"), year, (F.col("p_partkey") % 50).alias("citation_count"), F.col("p_partkey").alias("rank")
        )

    found = titles.metadata_by_title(papers, {source: catalog(place) for place, source in enumerate(A.SOURCES)})
    return found.select("ord", F.col("Year").cast("double"), "Citation_Count", "Metadata_Source")


def _digest_service(place, reply):
    """A metadata service that knows the titles whose MD5 has a low digit at ``place``."""

    def service():
        def send(title: str) -> str:
            digits = [int(digit, 16) for digit in hashlib.md5(title.encode()).hexdigest()]
            return json.dumps(reply(2000 + digits[0], digits[1]) if digits[place] < 6 else {})

        return send

    return service


def _digit(place: int) -> str:
    return f"(strpos('0123456789abcdef', substr(md5(title), {place + 1}, 1)) - 1)"


@query(
    f"""select ord, case when {_digit(2)} < 6 or {_digit(3)} < 6 or {_digit(4)} < 6
           then cast(2000 + {_digit(0)} as double) end as "Year",
         case when {_digit(2)} < 6 then {_digit(1)} when {_digit(3)} < 6 then 0 when {_digit(4)} < 6 then {_digit(1)}
           else 0 end as "Citation_Count",
         case when {_digit(2)} < 6 then 'semantic_scholar' when {_digit(3)} < 6 then 'crossref'
           when {_digit(4)} < 6 then 'openalex' else 'not_found' end as "Metadata_Source"
       from doc_papers""",
    ("doc_papers",),
)
def metadata_services(spark, sf_dir):
    services = {
        "semantic_scholar": _digest_service(2, lambda y, n: {"data": [{"year": y, "citationCount": n}]}),
        "crossref": _digest_service(3, lambda y, n: {"message": {"items": [{"issued": {"date-parts": [[y, 1]]}}]}}),
        "openalex": _digest_service(4, lambda y, n: {"results": [{"publication_year": y, "cited_by_count": n}]}),
    }
    papers = V.doc_papers(spark, sf_dir).select("ord", "title")
    found = metadata.with_metadata(papers, metadata.metadata_from_services(papers, services))
    return found.select("ord", F.col("Year").cast("double"), "Citation_Count", "Metadata_Source")


def _catalog_answer(source, catalog):
    """Catalog rows as that service would answer."""
    if source == "semantic_scholar":
        hit = F.struct(F.col("year"), F.col("citation_count").alias("citationCount"))
        return F.to_json(F.struct(F.array(hit).alias("data")))
    if source == "crossref":
        date = F.struct(F.array(F.array(F.col("year"), F.lit(5))).alias("date-parts"))
        hit = F.struct(date.alias("issued"))
        return F.to_json(F.struct(F.struct(F.array(hit).alias("items")).alias("message")))
    hit = F.struct(F.col("year").alias("publication_year"), F.col("citation_count").alias("cited_by_count"))
    return F.to_json(F.struct(F.array(hit).alias("results")))


@query(
    """select ord, cast(1990 + ord % 35 as int) as year,
         cast(case when source = 'crossref' then 0 else ord % 50 end as bigint) as citation_count, source
       from doc_papers, (values ('semantic_scholar'), ('crossref'), ('openalex')) s(source)""",
    ("doc_papers",),
)
def parse_metadata(spark, sf_dir):
    year = (F.lit(1990) + F.col("ord") % 35).cast("int").alias("year")
    papers = V.doc_papers(spark, sf_dir).select("ord", year, (F.col("ord") % 50).alias("citation_count"))
    parsed = [
        papers.select("ord", A.METADATA_PARSERS[source](_catalog_answer(source, papers)).alias("metadata"))
        for source in A.SOURCES
    ]
    return parsed[0].unionByName(parsed[1]).unionByName(parsed[2]).select("ord", "metadata.*")


# --- categories ------------------------------------------------------------


@query(
    """select p.ord, p.title, coalesce(c.category, 'Unclassified') as category
       from doc_papers p left join classification c on p.title = c.title""",
    ("doc_papers", "classification"),
)
def assign_category(spark, sf_dir):
    papers = V.doc_papers(spark, sf_dir).select("ord", "title")
    return batches.assign_category(papers, V.classification(spark, sf_dir))


@query(
    """select coalesce(c.category, 'Unclassified') as category, count(*) as papers
       from doc_papers p left join classification c on p.title = c.title group by 1""",
    ("doc_papers", "classification"),
)
def category_counts(spark, sf_dir):
    return batches.category_counts(assign_category(spark, sf_dir))


_WRAPPED = """select title, case length(title) % 5
    when 0 then concat('Sure.', chr(10), '```json', chr(10), j, chr(10), '``` end')
    when 1 then concat('Here: ', j, ' done')
    when 2 then j
    when 3 then concat('none: ', title)
    else concat('```json ', j, ' ') end as answer
  from (select title, concat('{"', title, '": "', category, '"}') as j from grades)"""


@query(
    f"""select title, case
          when contains(answer, '```json') then {V.sql_strip(
            "case when contains(rest, '```') then split_part(rest, '```', 1) else substr(rest, 1, length(rest) - 1) end"
          )}
          when contains(answer, '{{') and contains(answer, '}}')
            then regexp_extract(answer, '(\\{{.*\\}})', 1, 's')
          else answer end as json
        from (select *, substr(answer, strpos(answer, '```json') + 7) as rest from ({_WRAPPED}))""",
    ("grades",),
)
def json_slice(spark, sf_dir):
    title = F.col("title")
    inner = F.concat(F.lit('{"'), title, F.lit('": "'), F.col("category"), F.lit('"}'))
    kind = F.length(title) % 5
    answer = (
        F.when(kind == 0, F.concat(F.lit("Sure.\n```json\n"), inner, F.lit("\n``` end")))
        .when(kind == 1, F.concat(F.lit("Here: "), inner, F.lit(" done")))
        .when(kind == 2, inner)
        .when(kind == 3, F.concat(F.lit("none: "), title))
        .otherwise(F.concat(F.lit("```json "), inner, F.lit(" ")))
    )
    return V.grades(spark, sf_dir).select("title", A.json_slice(answer).alias("json"))


@query("select title, true as ok, category, 'about ' || title as description from grades", ("grades",))
def parse_classification(spark, sf_dir):
    title, category = F.col("title"), F.col("category")
    reply = F.to_json(
        F.struct(
            F.create_map(category, F.concat(F.lit("about "), title)).alias("categories"),
            F.create_map(title, category).alias("classifications"),
        )
    )
    answer = F.concat(F.lit("Answer\n```json\n"), reply, F.lit("\n```"))
    parsed = V.grades(spark, sf_dir).select(
        "title", A.parse_classification(A.json_slice(answer)).alias("parsed")
    )
    described = batches.described_categories(parsed, "title", "parsed")
    return described.select(
        "title", "parsed.ok", F.try_element_at(F.col("parsed.classifications"), title).alias("category"), "description"
    )


@query("select doc_id, concat(text, '|', lang) as translated from documents")
def parse_translation(spark, sf_dir):
    segments = F.array(F.array("text", F.lit("x")), F.array(F.lit(""), F.lit("y")), F.array(F.concat(F.lit("|"), "lang")))
    answer = F.to_json(F.array(segments))
    return V.documents(spark, sf_dir).select("doc_id", A.parse_translation(answer, F.col("text")).alias("translated"))


# --- batches ---------------------------------------------------------------


def _batched(spark, sf_dir):
    return batches.prompt_batches(V.doc_papers(spark, sf_dir), budget=2000, chunk_ords=500)


@query("select ord, search_key as bucket, batch from batched", ("batched",))
def prompt_batches(spark, sf_dir):
    return _batched(spark, sf_dir).select("ord", "bucket", "batch")


@query("select * from context", ("context",))
def classification_context(spark, sf_dir):
    return batches.batch_context(_batched(spark, sf_dir))


@query(
    """select *, cast(case when length(prompt) > 1000 then 2000 else 100 end as int) as max_tokens
       from (select bucket, batch,
         concat('Words: a, b; groups: 4', chr(10), papers_info, 'End') as prompt from context)""",
    ("context",),
)
def classification_prompts(spark, sf_dir):
    return batches.classification_prompts(
        batches.batch_context(_batched(spark, sf_dir)), V.SEARCH_WORDS, 4, V.GROUPING
    )


@query(
    f"""select ord, concat(title, ' / ', llm_summary, ' / a, b / 4') as prompt from doc_papers
        where not {V.sql_blank("llm_summary")}""",
    ("doc_papers",),
)
def paper_prompts(spark, sf_dir):
    words = F.array(*[F.lit(word) for word in V.SEARCH_WORDS])
    prompt = P.paper_prompt(F.col("title"), F.col("llm_summary"), words, 4, V.SINGLE)
    return V.doc_papers(spark, sf_dir).where(X.not_blank(F.col("llm_summary"))).select("ord", prompt.alias("prompt"))


@query(
    f"""select p.ord, p.title, case when h.search_key is null then ''
         when n.title is null or substr(md5(p.title), 1, 1) = '0' then 'Unclassified'
         else substr(md5(p.title), 1, 1) end as category
       from doc_papers p
         left join (select distinct search_key from doc_papers where not {V.sql_blank("llm_summary")}) h
           on p.search_key = h.search_key
         left join (select distinct search_key, title from doc_papers where not {V.sql_blank("llm_summary")}) n
           on p.search_key = n.search_key and p.title = n.title""",
    ("doc_papers",),
)
def classify_papers(spark, sf_dir):
    papers = V.doc_papers(spark, sf_dir)
    done = batches.classify_papers(
        papers, grouping_service, V.SEARCH_WORDS, 4, V.GROUPING, budget=2000, chunk_ords=500
    )
    return done.select("ord", "title", "category")


@query(
    f"""select p.ord, p.title, case when h.search_key is null then ''
         when n.title is null then 'Unclassified'
         when h.batches > 1 and h.groups > 4 then substr(md5(p.title), 1, 1) else substr(md5(p.title), 1, 2) end as category
       from doc_papers p
         left join (
           select search_key, count(distinct batch) as batches, count(distinct substr(md5(title), 1, 2)) as groups
           from batched where entry is not null group by search_key) h
           on p.search_key = h.search_key
         left join (select distinct search_key, title from doc_papers where not {V.sql_blank("llm_summary")}) n
           on p.search_key = n.search_key and p.title = n.title""",
    ("doc_papers", "batched"),
)
def merged_categories(spark, sf_dir):
    done = batches.classify_papers(
        V.doc_papers(spark, sf_dir), naming_service, V.SEARCH_WORDS, 4, V.GROUPING, budget=2000, chunk_ords=500
    )
    return done.select("ord", "title", "category")


# --- services --------------------------------------------------------------


@query(
    """select ord, md5(title) || case when substr(md5(title), 1, 1) >= '8' then '!' else '' end as answer,
         cast(null as varchar) as answer_error from doc_papers""",
    ("doc_papers",),
)
def answers_kept(spark, sf_dir):
    papers = V.doc_papers(spark, sf_dir).select("ord", "title")
    store = AnswerStore(new_path(spark, "answers"), wave=20_000)
    enrich.enrich(papers, F.col("title"), half_service, ["ord"], store=store)
    return enrich.enrich(papers, F.col("title"), marked_service, ["ord"], store=store).drop("title")


@query("select ord, md5(title) as answer, cast(null as varchar) as answer_error from doc_papers", ("doc_papers",))
def enrich_dedup(spark, sf_dir):
    papers = V.doc_papers(spark, sf_dir).select("ord", "title")
    return enrich.enrich(papers, F.col("title"), md5_service, ["ord"]).drop("title")


@query(
    f"""select ord, case when {V.sql_blank("abstract")} then '' else md5(abstract) end as abstract_translate
        from doc_papers""",
    ("doc_papers",),
)
def translate_column(spark, sf_dir):
    papers = V.doc_papers(spark, sf_dir).select("ord", "abstract")
    return enrich.translate_abstracts(papers, translation_service).select("ord", "abstract_translate")


@query("select ord, md5(title) || '|de|7' as answer, cast(null as varchar) as answer_error from doc_papers", ("doc_papers",))
def service_options(spark, sf_dir):
    papers = V.doc_papers(spark, sf_dir).select("ord", "title")
    answered = enrich.enrich(papers, F.col("title"), echo_service, ["ord"], language="de", max_tokens=7)
    return answered.drop("title")


@query(
    """select bucket, batch, md5(prompt) || '|none|' || case when length(prompt) > 1000 then 2000 else 100 end as result
       from (select bucket, batch,
         concat('Words: a, b; groups: 4', chr(10), papers_info, 'End') as prompt from context)""",
    ("context",),
)
def batch_budgets(spark, sf_dir):
    context = batches.batch_context(_batched(spark, sf_dir))
    prompts = batches.classification_prompts(context, V.SEARCH_WORDS, 4, V.GROUPING)
    return batches.ask_batches(prompts, echo_service).select("bucket", "batch", "result")


# --- questions -------------------------------------------------------------


@query("select * from page_text", ("page_text",))
def page_text(spark, sf_dir):
    return qa.page_text(V.doc_pages(spark, sf_dir))


@query(
    """select s.doc_id, cast(least(5, s.total) as bigint) as pages_read, s.total as total_pages, length(t.content) as chars
       from (select doc_id, count(*) as total from doc_pages group by doc_id) s join page_text t on s.doc_id = t.doc_id""",
    ("page_text",),
)
def page_stats(spark, sf_dir):
    return qa.page_stats(V.doc_pages(spark, sf_dir))


@query(
    f"""select item_id, cast(row_number() over (partition by item_id order by pos) as int) as q_idx, question
        from (select item_id, {V.sql_strip("line")} as question, pos
          from (select item_id, unnest(string_split(text, chr(10))) as line,
            generate_subscripts(string_split(text, chr(10)), 1) as pos from benchmark))
        where question <> ''"""
)
def question_list(spark, sf_dir):
    return qa.number_questions(V.table(spark, sf_dir, "benchmark"), "item_id")


@query(
    "select d.doc_id, q.q_idx, q.question, d.n_chars from documents d, questions q",
    ("questions",),
)
def doc_question_pairs(spark, sf_dir):
    return qa.with_questions(V.documents(spark, sf_dir).select("doc_id", "n_chars"), V.QUESTIONS)


_PROMPT = """concat('Text:', chr(10), substr(content, 1, 8000), chr(10), 'Question: ', question, chr(10),
    'Use {braces} as they are.')"""


@query(
    f"select doc_id, q_idx, question, {_PROMPT} as prompt from page_text, questions",
    ("page_text", "questions"),
)
def qa_prompts(spark, sf_dir):
    return qa.qa_prompts(qa.page_text(V.doc_pages(spark, sf_dir), limit=P.TEXT_LIMIT), V.QUESTIONS, V.READING)


@query(
    "select doc_id, "
    + ", ".join(
        f"max({name}) filter (where q_idx = {number}) as {name}_{number}"
        for number in range(1, len(V.QUESTIONS) + 1)
        for name in ("question", "answer")
    )
    + f" from (select doc_id, q_idx, question, md5({_PROMPT}) as answer from page_text, questions) group by doc_id",
    ("page_text", "questions"),
)
def qa_answers(spark, sf_dir):
    return answer_table(V.doc_pages(spark, sf_dir), V.QUESTIONS, md5_service, template=V.READING)


# The columns of the SQL: questions a conversation of the test tables has at most.
# The query itself has as many as its table needs.
_WIDE = 4


@query(
    "select doc_id, "
    + ", ".join(
        f"max({name}) filter (where q_idx = {number}) as {name}_{number}"
        for number in range(1, _WIDE + 1)
        for name in ("question", "answer")
    )
    + " from qa_long group by doc_id",
    ("qa_long",),
)
def qa_wide(spark, sf_dir):
    answers = V.qa_long(spark, sf_dir)
    return qa.qa_wide(answers, answers.agg(F.max("q_idx")).first()[0] or 0)


@query(
    """select doc_id, q_idx, substr(question, 1, 50) || '...' as question,
         coalesce(substr(answer, 1, 100), '') || '...' as answer
       from qa_long where doc_id in (select distinct doc_id from qa_long order by doc_id limit 2)""",
    ("qa_long",),
)
def answer_preview(spark, sf_dir):
    return qa.preview_answers(qa_wide(spark, sf_dir))


@query("select doc_id, q_idx, question, answer from qa_long", ("qa_long",))
def qa_unpivot(spark, sf_dir):
    return qa.qa_unpivot(qa_wide(spark, sf_dir))


@query(
    """select doc_id, q_idx, cast(rank as int) as rank, page_no, score from (
          select *, row_number() over (partition by doc_id, q_idx order by score desc, page_no) as rank from (
            select t.doc_id, t.page_no, q.q_idx, round(coalesce(s.score, 0e0), 6) as score
            from tokens t cross join (select q_idx from questions) q left join (
              select f.doc_id, f.page_no, k.q_idx, sum(ln(1e0 + (c.n - d.df + 0.5e0) / (d.df + 0.5e0)) * f.tf * 2.2e0
                / (f.tf + 1.2e0 * (0.25e0 + 0.75e0 * f.length / c.avg_length))) as score
              from tf f join terms k on f.term = k.term join (select term, count(*) as df from tf group by term) d
                on d.term = f.term cross join (select count(*) as n, avg(length) as avg_length from tokens) c
              group by f.doc_id, f.page_no, k.q_idx) s
            on s.doc_id = t.doc_id and s.page_no = t.page_no and s.q_idx = q.q_idx))
        where rank <= 2""",
    ("doc_pages", "questions", "tokens", "tf", "terms"),
)
def qa_passages(spark, sf_dir):
    return passages.qa_passages(V.doc_pages(spark, sf_dir), V.QUESTIONS, top_k=2)


@query(
    r"""select word, count(*) as n, count(distinct doc_id) as docs,
          round(count(*) * ln(((select count(*) from documents) + 1e0) / (count(distinct doc_id) + 1e0)), 6) as weight
        from (select doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))
          as word from documents) group by word"""
)
def topic_weights(spark, sf_dir):
    weights = topics.word_weights(spread(V.documents(spark, sf_dir).select("doc_id", "text"), "doc_id"))
    return weights.withColumn("weight", F.round("weight", 6))


def _topics_sql(k: int = 4, rounds: int = topics.ROUNDS, seed: int = 42) -> str:
    """Spherical k-means step by step: seeds far from each other, then the rounds."""

    def nearest(name: str, centers: str) -> str:
        return f"""{name} as materialized (
          select doc_id, coalesce(arg_max(c, (dot, -c)), 0) as c from (
            select d.doc_id, s.c, s.dot from (select distinct doc_id from documents) d left join (
              select v.doc_id, t.c, sum(v.w * t.w) as dot from vectors v join {centers} t on v.place = t.place
              group by v.doc_id, t.c) s on s.doc_id = d.doc_id)
          group by doc_id)"""

    parts = [
        r"""words as materialized (select doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'),
            lambda w: w <> '')) as word from documents),
          total as (select count(*) as docs from documents)""",
        f"""counts as materialized (select doc_id, cast('0x' || substr(md5(word), 1, 7) as int) % {topics.FEATURES} as place,
            count(*) as n from words group by all)""",
        """weights as (select doc_id, place, n * ln((docs + 1e0) / (held + 1e0)) as x
            from counts join (select place, count(*) as held from counts group by place) using (place) cross join total)""",
        f"""vectors as materialized (select doc_id, place, cast(round({topics.LENGTH} * x / norm) as bigint) as w
            from (select *, sqrt(sum(x * x) over (partition by doc_id)) as norm from weights) where norm > 0)""",
        f"""ordered as (select distinct doc_id, md5(concat('{seed}:', doc_id)) as digest from vectors)""",
        """seeds1 as materialized (select 0 as c, arg_min(doc_id, digest) as doc_id from ordered)""",
    ]
    for i in range(1, k):
        parts.append(f"""seeds{i + 1} as materialized (select * from seeds{i} union all
          select {i}, arg_min(doc_id, (near, digest)) from (
            select o.doc_id, o.digest, coalesce(max(s.dot), 0) as near from ordered o left join (
              select v.doc_id, t.c, sum(v.w * u.w) as dot from seeds{i} t join vectors u on u.doc_id = t.doc_id
              join vectors v on v.place = u.place group by v.doc_id, t.c) s on s.doc_id = o.doc_id
            group by o.doc_id, o.digest))""")
    parts.append(f"centers0 as materialized (select c, place, w from seeds{k} join vectors using (doc_id))")
    for r in range(rounds):
        parts.append(nearest(f"nearest{r}", f"centers{r}"))
        parts.append(f"""centers{r + 1} as materialized (
          with sums as (select c, place, sum(w)::double as s from nearest{r} join vectors using (doc_id) group by c, place)
          select c, place, cast(round({topics.LENGTH} * s / sqrt(sum(s * s) over (partition by c))) as bigint) as w from sums
          union all select * from centers{r} where c not in (select c from sums))""")
    parts.append(nearest("clustered", f"centers{rounds}"))
    return f"""with {", ".join(parts)},
      names as (select c, string_agg(word, ' ' order by rank) as topic from (
        select *, row_number() over (partition by c order by weight desc, word) as rank from (
          select c, word, round(count(*) * ln(((select docs from total) + 1e0) / (any_value(f.docs) + 1e0)), 6) as weight
          from words join clustered using (doc_id)
          join (select word, count(distinct doc_id) as docs from words group by word) f using (word) group by c, word))
        where rank <= 3 group by c)
      select doc_id, cast(c as int) as cluster, coalesce(topic, '') as topic from clustered left join names using (c)"""


@query(_topics_sql())
def topic_clusters(spark, sf_dir):
    return topics.topic_clusters(spread(V.documents(spark, sf_dir).select("doc_id", "text"), "doc_id"))
