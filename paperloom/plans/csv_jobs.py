"""Paper files in, paper files with one more column out."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.urls import classified_file_name, translated_file_name
from paperloom.operators.answer_store import AnswerStore
from paperloom.operators.batches import classify_papers
from paperloom.operators.enrich import Service, translate_abstracts
from paperloom.sources.durable import cut_lineage
from paperloom.sources.files import file_name, read_split_papers, write_papers


def _base(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path.rstrip("/")))[0]


# Names the jobs use themselves; a file's own columns of these names step aside.
_OWN = ("ord", "source_file")


def numbered(spark: SparkSession, source: str) -> DataFrame:
    """The papers of a file or folder, read by many tasks, with ``ord``: unique and in
    file order. They are written down, as later steps read them more than once."""
    papers = read_split_papers(spark, source, position="_place")
    aside = papers.withColumnsRenamed({name: f"_file_{name}" for name in _OWN})
    return cut_lineage(aside.withColumnRenamed("_place", "ord"))


def _finished(papers: DataFrame) -> DataFrame:
    return papers.drop(*_OWN).withColumnsRenamed({f"_file_{name}": name for name in _OWN})


def translate_csv(
    spark: SparkSession,
    source: str,
    folder: str,
    service: Service,
    language: str = "zh-cn",
    name: str | None = None,
    parallelism: int | None = None,
    store: AnswerStore | None = None,
) -> str:
    """Translate the abstracts of a paper file; returns the path written."""
    target = name or file_name(spark, translated_file_name(F.lit(_base(source)), F.lit(language)))
    papers = translate_abstracts(numbered(spark, source), service, parallelism=parallelism, language=language, store=store)
    return write_papers(_finished(papers), posixpath.join(folder, target))


def classify_csv(
    spark: SparkSession,
    source: str,
    folder: str,
    service: Service,
    words: Sequence[str],
    num_categories: int = 4,
    name: str | None = None,
    parallelism: int | None = None,
    store: AnswerStore | None = None,
) -> str:
    """Classify the papers of a file; returns the path written."""
    target = name or file_name(spark, classified_file_name(F.lit(_base(source))))
    papers = numbered(spark, source).withColumn("source_file", F.lit(source))
    done = classify_papers(papers, service, words, num_categories, bucket="source_file", parallelism=parallelism, store=store)
    return write_papers(_finished(done), posixpath.join(folder, target))
