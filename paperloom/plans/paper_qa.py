"""Page text and questions to the wide answer file."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.prompts import READING_TEMPLATE, TEXT_LIMIT
from paperloom.functions.urls import qa_file_name
from paperloom.operators.answer_store import AnswerStore
from paperloom.operators.enrich import Service
from paperloom.operators.qa import MAX_PAGES, answer_questions, qa_wide
from paperloom.sources.files import file_name, pdf_listing, write_answers


def answer_table(
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
    """One row per document with each question and its answer.

    ``documents`` (its ``doc_id``) lists documents that may have no pages, such as a
    PDF folder; ``limit`` cuts the text of a prompt, None leaves it whole. What ``store``
    has from an earlier run is not asked again.
    """
    answers = answer_questions(pages, questions, service, max_pages, template, parallelism, limit, documents, store)
    return qa_wide(answers, len(questions))


def answer_folder(
    spark: SparkSession, folder: str, pages: DataFrame, questions: Sequence[str], service: Service, **options
) -> DataFrame:
    """The answers for every PDF file directly in a folder, by its file name.

    ``pages(doc_id, page_no, text)`` are the texts read from them, ``doc_id`` the
    file name. A file without pages gets the message for a text that cannot be
    read, pages of files not in the folder are left out. ``options`` are those of
    ``answer_table``. A folder without PDF files raises.
    """
    listed = pdf_listing(spark, folder).select(F.col("pdf_filename").alias("doc_id"))
    if listed.isEmpty():
        raise ValueError(f"no PDF files in {folder}")
    return answer_table(pages, questions, service, documents=listed, **options)


def save_answers(wide: DataFrame, folder: str, source_name: str = "results", name: str | None = None) -> str:
    """Write the table under a name with the time in it; returns the path."""
    target = name or file_name(wide.sparkSession, qa_file_name(F.lit(source_name), F.lit(datetime.now())))
    return write_answers(wide, posixpath.join(folder, target))
