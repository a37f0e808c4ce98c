"""Questions to documents: page text, prompts, answers, wide and long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.prompts import QA_BUDGET, READING_TEMPLATE, TEXT_LIMIT, reading_prompt
from paperloom.functions.text import label, strip, truncate
from paperloom.operators.answer_store import AnswerStore
from paperloom.operators.enrich import CALL_FAILED, Service, enrich
from paperloom.sources.durable import cut_lineage

MAX_PAGES = 5

# Fixed value: the answer for a document without text.
NO_TEXT = "Error: Unable to extract PDF text"


def question_lines(text: Column) -> Column:
    """Questions in a text, one per line, trimmed, blank lines dropped."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), strip)
    return F.filter(lines, lambda line: line != "")


def number_questions(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``(keys, q_idx, question)``, numbered from 1 after blanks are dropped."""
    return rows.select(*keys, F.posexplode(question_lines(F.col(text))).alias("pos", "question")).select(
        *keys, (F.col("pos") + 1).alias("q_idx"), "question"
    )


def page_text(pages: DataFrame, max_pages: int | None = MAX_PAGES, limit: int | None = None) -> DataFrame:
    """``(doc_id, content)``: marked texts of the first pages, empty pages left out.

    Page numbers count empty pages too. The page limit reaches the scan. With a
    ``limit`` only the first so many characters are wanted: each page is cut to
    them before the shuffle and the joined text once more, so a document moves at
    most ``limit`` characters per page read, however long its pages are.
    """
    if max_pages is not None and max_pages < 1:
        raise ValueError("max_pages must be positive")
    read = pages if max_pages is None else pages.where(F.col("page_no") <= max_pages)
    marked = read.select("doc_id", "page_no", truncate(_marked_page(), limit).alias("piece"))
    joined = F.expr("listagg(piece, '\\n\\n') within group (order by page_no)")
    return marked.groupBy("doc_id").agg(truncate(F.coalesce(joined, F.lit("")), limit).alias("content"))


def _marked_page() -> Column:
    heading = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"))
    return F.when(F.col("text") != "", F.concat(heading, F.col("text")))


def page_stats(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Pages read, pages in all and characters of the joined text per document.

    Only lengths are shuffled, and they are summed before that.
    """
    length = F.length(F.when(F.col("page_no") <= max_pages, _marked_page()))
    separators = F.greatest(F.count(length) - 1, F.lit(0))
    return pages.groupBy("doc_id").agg(
        F.least(F.count(F.lit(1)), F.lit(max_pages)).alias("pages_read"),
        F.count(F.lit(1)).alias("total_pages"),
        (F.coalesce(F.sum(length), F.lit(0)) + 2 * separators).alias("chars"),
    )


def with_questions(docs: DataFrame, questions: Sequence[str]) -> DataFrame:
    """Every document with every question, ``q_idx`` from 1.

    The questions are a list in the program and go into the plan as a literal
    array that each row unfolds: no join, no shuffle.
    """
    if not questions or not all(question.strip() for question in questions):
        raise ValueError("questions must not be blank")
    listed = F.array(*[F.lit(question) for question in questions])
    return docs.select("*", F.posexplode(listed).alias("pos", "question")).select(
        *docs.columns, (F.col("pos") + 1).alias("q_idx"), "question"
    )


def qa_prompts(
    contents: DataFrame,
    questions: Sequence[str],
    template: str = READING_TEMPLATE,
    limit: int | None = TEXT_LIMIT,
) -> DataFrame:
    """``(doc_id, q_idx, question, prompt)`` for documents with text. The text
    is cut before rows are multiplied."""
    cut = contents.where(F.col("content") != "").select("doc_id", truncate(F.col("content"), limit).alias("content"))
    asked = with_questions(cut, questions)
    prompt = reading_prompt(F.col("content"), F.col("question"), template, limit=None)
    return asked.select("doc_id", "q_idx", "question", prompt.alias("prompt"))


def answer_questions(
    pages: DataFrame,
    questions: Sequence[str],
    service: Service,
    max_pages: int | None = MAX_PAGES,
    template: str = READING_TEMPLATE,
    parallelism: int | None = None,
    limit: int | None = TEXT_LIMIT,
    documents: DataFrame | None = None,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Long table ``(doc_id, q_idx, question, answer)``.

    Every document of ``documents`` (its ``doc_id``), or of ``pages``, has its
    answers. A document without text, or without any page up to the limit, gets the fixed message for every question and is
    not sent; a failed call gets its message. A ``store`` keeps answers for later runs. The texts are put together once
    and kept, as prompts and answers both need them.
    """
    listed = (pages if documents is None else documents).select("doc_id").distinct()
    read = listed.join(page_text(pages, max_pages, limit), "doc_id", "left")
    contents = cut_lineage(read.select("doc_id", F.coalesce("content", F.lit("")).alias("content")), "contents")
    prompts = qa_prompts(contents, questions, template, limit)
    answered = enrich(prompts, F.col("prompt"), service, ["doc_id", "q_idx"], parallelism, store, max_tokens=QA_BUDGET)
    failed = F.concat(F.lit(CALL_FAILED), F.coalesce("answer_error", F.lit("no answer")))
    answers = answered.select("doc_id", "q_idx", "question", F.coalesce(strip(F.col("answer")), failed).alias("answer"))
    empty = with_questions(contents.where(F.col("content") == "").select("doc_id"), questions)
    return answers.unionByName(empty.withColumn("answer", F.lit(NO_TEXT)))


def qa_wide(answers: DataFrame, num_questions: int, key: str = "doc_id") -> DataFrame:
    """One row per document: ``question_1, answer_1, question_2, ...``."""

    def at(index: int, name: str) -> Column:
        value = F.first(F.when(F.col("q_idx") == index, F.col(name)), ignorenulls=True)
        return value.alias(f"{name}_{index}")

    columns = [at(index, name) for index in range(1, num_questions + 1) for name in ("question", "answer")]
    return answers.groupBy(key).agg(*columns)


def qa_unpivot(wide: DataFrame, key: str = "doc_id") -> DataFrame:
    """Wide table back to long. Pairs are found by column name; a missing
    question drops its pair."""
    pairs = []
    for name in wide.columns:
        number = name.removeprefix("question_")
        if name.startswith("question_") and f"answer_{number}" in wide.columns:
            pairs.append(f"{number}, `{name}`, `answer_{number}`")
    stacked = wide.select(key, F.expr(f"stack({len(pairs)}, {', '.join(pairs)}) as (q_idx, question, answer)"))
    return stacked.where(F.col("question").isNotNull())


def preview_answers(wide: DataFrame, rows: int = 2, key: str = "doc_id") -> DataFrame:
    """Cut questions and answers of the first documents."""
    pairs = qa_unpivot(wide.orderBy(key).limit(rows), key)
    return pairs.select(
        key, "q_idx", label(F.col("question"), 50).alias("question"), label(F.col("answer"), 100).alias("answer")
    )
