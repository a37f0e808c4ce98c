"""Which PDF of which paper to fetch, from where, to where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.urls import is_arxiv, pdf_filename, pdf_path, pdf_url
from paperloom.operators.lookup import lookup, prefilter

REUSE, FETCH, NO_ARXIV = "reuse", "fetch", "no_arxiv"


def target_paths(papers: DataFrame, words: Sequence[str]) -> DataFrame:
    """Add the address to fetch and the path to keep it at; both NULL off arXiv."""
    wanted = is_arxiv(F.col("pdf_url"))
    folder_words = F.array(*[F.lit(word) for word in words])
    path = pdf_path(folder_words, pdf_filename(F.col("pdf_url"), F.col("title")))
    return papers.select(
        *papers.columns,
        F.when(wanted, pdf_url(F.col("pdf_url"))).alias("fetch_url"),
        F.when(wanted, path).alias("pdf_path"),
    )


def pdf_plan(
    papers: DataFrame, words: Sequence[str], manifest: DataFrame, keys: Sequence[str] = ("ord",)
) -> DataFrame:
    """Add address, path and status to every paper.

    ``manifest(pdf_path)`` lists the files already there. ``pdf_conflict`` marks
    papers that share their path with a paper of another address. Per path,
    addresses and files come together in one aggregate, so the papers are joined
    once and a path shared by very many papers is dealt over tasks.
    """
    targets = target_paths(papers, words)
    wanted = targets.where(F.col("pdf_path").isNotNull())
    seen = wanted.select("pdf_path", "fetch_url", F.lit(False).alias("present")).unionByName(
        manifest.select("pdf_path", F.lit(None).cast("string").alias("fetch_url"), F.lit(True).alias("present"))
    )
    per_path = seen.groupBy("pdf_path").agg(
        F.bool_or("present").alias("present"),
        (F.min("fetch_url") < F.max("fetch_url")).alias("conflict"),
    )
    status = F.when(F.col("pdf_path").isNull(), NO_ARXIV).when(F.col("present"), REUSE).otherwise(FETCH)
    return lookup(targets, per_path, "pdf_path", spread_by=keys).select(
        *papers.columns,
        "fetch_url",
        "pdf_path",
        status.alias("pdf_status"),
        F.coalesce("conflict", F.lit(False)).alias("pdf_conflict"),
    )


def pdf_todo(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files still to fetch: one row per path, the smallest address of it."""
    files = targets.where(F.col("pdf_path").isNotNull()).groupBy("pdf_path").agg(F.min("fetch_url").alias("fetch_url"))
    return files.join(manifest, "pdf_path", "left_anti")


def pdf_reused(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files wanted and already there, with the number of papers using each. A
    filter of the files there keeps most others from being counted."""
    files = prefilter(targets, manifest, "pdf_path").groupBy("pdf_path").agg(F.count(F.lit(1)).alias("papers"))
    return files.join(manifest, "pdf_path", "left_semi")


def pdf_summary(plan: DataFrame) -> DataFrame:
    has_file = F.col("pdf_path").isNotNull() & (F.col("pdf_path") != "")
    return plan.agg(
        F.count_if(has_file).alias("pdfs"),
        F.count_if(F.col("pdf_status") == FETCH).alias("to_fetch"),
        F.count_if(F.col("pdf_status") == REUSE).alias("reused"),
        F.count(F.lit(1)).alias("papers"),
    )
