"""Tables the queries start from, derived from the given ones.

The given tables hold no arXiv links, paper records, catalogs or manifests, so
these are made from ids and texts. Every view covers its whole table. ``SQL``
has the same views for the SQL side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.passages import question_terms
from paperloom.sources.files import spread

# What is asked of every document, in the words of the corpus languages.
QUESTIONS = (
    "What does the thanedble attion say, and who is that for?",
    "Was ist aulich für sch?",
    "Que dit la leenéelle des eaux?",
)
SEARCH_WORDS = ("a", "b")
PAGE_CHARS = 3000
READING = "Text:\n{pdf_content}\nQuestion: {question}\nUse {{braces}} as they are."
GROUPING = "Words: {keywords}; groups: {num_categories}\n{papers_info}End"
SINGLE = "{title} / {summary} / {keywords} / {num_categories}"


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its footer is read once."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def paper_url() -> Column:
    return F.concat(F.lit("https://host.example/papers/2401."), (F.col("page_id") + 10000).cast("string"))


def page_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("page_id") + 10000).cast("string")
    url = paper_url()
    kind = F.col("page_id") % 6
    link = (
        F.when(kind == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), number))
        .when(kind == 1, F.concat(F.lit("https://arxiv.org/pdf/2401."), number, F.lit("v2")))
        .when(kind == 2, F.concat(F.lit("https://arxiv.org/pdf/2401."), number, F.lit(".pdf")))
        .when(kind == 3, url)
        .when(kind == 4, F.lit(""))
    )
    title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return pages(spark, sf_dir).select(
        "page_id", F.col("url").alias("page_url"), url.alias("url"), link.alias("pdf_url"), title.alias("title")
    )


def doc_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.substring_index(F.substring_index("text", "\n", 2), "\n", -1)
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("search_key"),
        "lang",
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.col("lang") != "es", F.when(F.col("text").contains("\n"), second).otherwise("")).alias("llm_summary"),
        F.when(F.col("source") == "src3", "  \n").when(F.col("source") != "src5", F.col("text")).alias("abstract"),
        F.when(F.col("n_chars") < 400, "404 Not Found").alias("error"),
    )


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = F.expr(f"regexp_extract_all(text, '(?s).{{1,{PAGE_CHARS}}}', 0)")
    return (
        spread(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
        .select("doc_id", F.posexplode(slices).alias("pos", "text"))
        .select("doc_id", (F.col("pos") + 1).alias("page_no"), "text")
    )


def qa_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    asked = said.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    answered = said.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    return asked.join(answered, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("doc_id"),
        F.floor((F.col("turn") + 1) / 2).cast("int").alias("q_idx"),
        "question",
        "answer",
    )


def _year(base: int, span: int) -> Column:
    return (base + F.col("ord") % span).cast("int").alias("year")


def catalogs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    papers = doc_papers(spark, sf_dir).select("ord", "title", "lang")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"))
    rank = F.col("ord").alias("rank")
    return {
        "semantic_scholar": papers.join(labelled, "ord").select(
            "title", rank, _year(2000, 25), (F.col("ord") % 50).alias("citation_count")
        ),
        "crossref": papers.where(F.col("lang").isin("de", "fr")).select(
            "title", rank, _year(1990, 35), F.lit(0).cast("bigint").alias("citation_count")
        ),
        "openalex": papers.where(F.col("lang") == "en").select(
            "title", rank, _year(2010, 15), (F.col("ord") % 90).alias("citation_count")
        ),
    }


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality")
    papers = doc_papers(spark, sf_dir).select("ord", "title")
    best = papers.join(labels, "ord").groupBy("title").agg(F.max("quality").alias("quality"))
    return best.select(
        "title", F.when(F.col("quality") == 1, "High quality").otherwise("Low quality").alias("category")
    )


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category for every title, of documents without a label too."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality")
    papers = doc_papers(spark, sf_dir).select("ord", "title").where(F.col("title").isNotNull())
    best = papers.join(labels, "ord", "left").groupBy("title").agg(F.max("quality").alias("quality"))
    named = F.when(F.col("quality") == 1, "High quality").when(F.col("quality").isNotNull(), "Low quality")
    return best.select("title", named.otherwise("Not graded").alias("category"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("page_id") + 10000).cast("string")
    found = pages(spark, sf_dir).where(F.length("html") < 2000)
    return found.select(F.concat(F.lit("pdfs/a_b/2401."), number, F.lit("v2.pdf")).alias("pdf_path"))


def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct()


# --- the same views for the SQL side --------------------------------------

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(value: str) -> str:
    return rf"regexp_replace({value}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def sql_blank(value: str) -> str:
    return f"(coalesce({sql_strip(value)}, '') = '')"


def sql_text(value: str) -> str:
    """Decoded, stripped text of markup without inner tags. Cut-off titles can
    end in an entity without its semicolon, which HTML reads all the same."""
    for entity, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        value = f"regexp_replace({value}, '&{entity}(;|$)', '{char}', 'g')"
    return sql_strip(value)


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = {
    "page_papers": """
        select page_id, url as page_url, concat('https://host.example/papers/2401.', page_id + 10000) as url,
          case page_id % 6
            when 0 then concat('https://arxiv.org/abs/2401.', page_id + 10000)
            when 1 then concat('https://arxiv.org/pdf/2401.', page_id + 10000, 'v2')
            when 2 then concat('https://arxiv.org/pdf/2401.', page_id + 10000, '.pdf')
            when 3 then concat('https://host.example/papers/2401.', page_id + 10000)
            when 4 then '' end as pdf_url,
          regexp_extract(html, '<h1>([^<]*)</h1>', 1) as title
        from pages""",
    "doc_papers": """
        select doc_id as ord, source as search_key, lang, split_part(text, chr(10), 1) as title,
          case when lang <> 'es' then split_part(text, chr(10), 2) end as llm_summary,
          case when source = 'src3' then '  ' || chr(10) when source <> 'src5' then text end as abstract,
          case when n_chars < 400 then '404 Not Found' end as error
        from documents""",
    "doc_pages": f"""
        select doc_id, cast(page_no as int) as page_no, substr(text, (page_no - 1) * {PAGE_CHARS} + 1, {PAGE_CHARS}) as text
        from documents, unnest(generate_series(1, cast(ceil(length(text) / {PAGE_CHARS}.0) as int))) t(page_no)""",
    "questions": "select * from (values "
    + ", ".join(f"({number}, {sql_literal(text)})" for number, text in enumerate(QUESTIONS, 1))
    + ") t(q_idx, question)",
    "qa_long": """
        select u.conv_id as doc_id, cast(floor((u.turn + 2) / 2) as int) as q_idx, u.text as question, a.text as answer
        from conversations u left join conversations a
          on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
        where u.role = 'user'""",
    "cat_s2": """
        select title, cast(2000 + ord % 25 as int) as year, cast(ord % 50 as bigint) as citation_count
        from (select title, min(ord) as ord from doc_papers join labels on ord = doc_id group by title)""",
    "cat_crossref": """
        select title, cast(1990 + ord % 35 as int) as year, cast(0 as bigint) as citation_count
        from (select title, min(ord) as ord from doc_papers where lang in ('de', 'fr') group by title)""",
    "cat_openalex": """
        select title, cast(2010 + ord % 15 as int) as year, cast(ord % 90 as bigint) as citation_count
        from (select title, min(ord) as ord from doc_papers where lang = 'en' group by title)""",
    "waterfall": """
        select p.*,
          case when s.title is not null then s.year when c.title is not null then c.year else o.year end as "Year",
          coalesce(case when s.title is not null then s.citation_count when c.title is not null then c.citation_count
            else o.citation_count end, 0) as "Citation_Count",
          case when s.title is not null then 'semantic_scholar' when c.title is not null then 'crossref'
            when o.title is not null then 'openalex' else 'not_found' end as "Metadata_Source"
        from doc_papers p left join cat_s2 s on p.title = s.title left join cat_crossref c on p.title = c.title
          left join cat_openalex o on p.title = o.title""",
    "classification": """
        select p.title, case max(l.quality) when 1 then 'High quality' else 'Low quality' end as category
        from doc_papers p join labels l on p.ord = l.doc_id group by p.title""",
    "grades": """
        select p.title, case when max(l.quality) = 1 then 'High quality' when max(l.quality) is not null then 'Low quality'
          else 'Not graded' end as category
        from doc_papers p left join labels l on p.ord = l.doc_id where p.title is not null group by p.title""",
    "manifest": """
        select concat('pdfs/a_b/2401.', page_id + 10000, 'v2.pdf') as pdf_path
        from pages where length(html) < 2000""",
    "search_words": "select distinct p_name from part",
    "titles": r"""
        select *, replace(rtrim(regexp_replace(title, '[^\p{L}\p{N} _-]', '', 'g'), ' '), ' ', '_') as cleaned
        from page_papers""",
    "targets": """
        select page_id, pdf_url, title,
          case when is_arxiv then case when pdf_url like '%/abs/%' then replace(pdf_url, '/abs/', '/pdf/') || '.pdf'
            when pdf_url like '%/pdf/%' and pdf_url not like '%.pdf' then pdf_url || '.pdf' else pdf_url end
          end as fetch_url,
          case when is_arxiv then 'pdfs/a_b/' || case when pdf_url like '%/pdf/%'
            then replace(split_part(pdf_url, '/pdf/', -1), '.pdf', '') || '.pdf'
            when coalesce(title, '') <> '' then substr(cleaned, 1, 50) || '.pdf' else 'paper.pdf' end
          end as pdf_path
        from (select *, coalesce(pdf_url like '%arxiv.org%' and (pdf_url like '%/abs/%' or pdf_url like '%/pdf/%'),
          false) as is_arxiv from titles)""",
    "pdf_plan": """
        select t.page_id, t.pdf_url, t.fetch_url, t.pdf_path,
          case when t.pdf_path is null then 'no_arxiv' when m.pdf_path is not null then 'reuse' else 'fetch' end
            as pdf_status,
          coalesce(c.n > 1, false) as pdf_conflict
        from targets t left join manifest m on t.pdf_path = m.pdf_path
          left join (select pdf_path, count(distinct fetch_url) as n from targets group by pdf_path) c
            on t.pdf_path = c.pdf_path""",
    "batched": f"""
        select ord, search_key, title, llm_summary, entry,
          greatest(cast(floor((sum(coalesce(length(entry), 0)) over (partition by search_key order by ord
            rows between unbounded preceding and current row) - 1) / 2000.0) as bigint), 0) as batch
        from (select *, case when not {sql_blank("llm_summary")}
          then concat('Title: ', title, chr(10), 'Summary: ', llm_summary, chr(10), chr(10)) end as entry
          from doc_papers)""",
    "context": """
        select search_key as bucket, batch, count(*) as papers, string_agg(entry, '' order by ord) as papers_info
        from batched where entry is not null group by search_key, batch""",
    "page_text": """
        select doc_id, string_agg(concat('--- Page ', page_no, ' ---', chr(10), text), chr(10) || chr(10)
          order by page_no) as content
        from doc_pages where page_no <= 5 and text <> '' group by doc_id""",
}

_TERMS = ", ".join(
    f"({number}, {sql_literal(term)})" for number, text in enumerate(QUESTIONS, 1) for term in question_terms(text)
)
SQL |= {
    "terms": f"select * from (values {_TERMS}) t(q_idx, term)",
    "tokens": r"""
        select doc_id, page_no, words, len(words) as length
        from (select doc_id, page_no,
          list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as words from doc_pages)""",
    "tf": """
        select doc_id, page_no, length, term, count(*) as tf
        from (select doc_id, page_no, length, unnest(words) as term from tokens)
        where term in (select term from terms) group by doc_id, page_no, length, term""",
}

# Which views a view is made of.
_NEEDS = {
    "cat_s2": ["doc_papers"],
    "cat_crossref": ["doc_papers"],
    "cat_openalex": ["doc_papers"],
    "waterfall": ["doc_papers", "cat_s2", "cat_crossref", "cat_openalex"],
    "classification": ["doc_papers"],
    "grades": ["doc_papers"],
    "titles": ["page_papers"],
    "targets": ["titles"],
    "pdf_plan": ["targets", "manifest"],
    "batched": ["doc_papers"],
    "context": ["batched"],
    "page_text": ["doc_pages"],
    "tokens": ["doc_pages"],
    "tf": ["tokens", "terms"],
}


def with_views(names: Sequence[str], body: str) -> str:
    """``body`` behind the views it names and those they are made of."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    if not ordered:
        return body
    return "with " + ", ".join(f"{name} as ({SQL[name]})" for name in ordered) + " " + body
