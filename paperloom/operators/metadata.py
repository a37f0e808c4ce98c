"""Year and citation count of papers, from several sources in turn."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.answers import METADATA_PARSERS, NOT_FOUND, SOURCES
from paperloom.operators.answer_store import AnswerStore
from paperloom.operators.enrich import ask
from paperloom.operators.lookup import lookup


def first_source(catalogs: Mapping[str, DataFrame], order: Sequence[str] = SOURCES) -> DataFrame:
    """One ``metadata`` struct per title, whole from the first source that has it.

    Each catalog is ``(title, year, citation_count)`` with an optional ``rank``;
    of several rows for a title the lowest rank is the hit. All catalogs go
    through a single aggregate, pre-combined in each partition. A winner without
    a year stays the winner.
    """

    def labelled(place: int, source: str) -> DataFrame:
        catalog = catalogs[source]
        rank = F.col("rank") if "rank" in catalog.columns else F.lit(0)
        return catalog.select(
            "title",
            F.struct(F.lit(place).alias("place"), rank.cast("bigint").alias("rank")).alias("turn"),
            F.struct(
                F.col("year").cast("int").alias("year"),
                F.col("citation_count").cast("bigint").alias("citation_count"),
                F.lit(source).alias("source"),
            ).alias("metadata"),
        )

    tables = [labelled(place, source) for place, source in enumerate(order) if source in catalogs]
    every = reduce(DataFrame.unionByName, tables).where(F.col("title").isNotNull())
    # The smallest (turn, metadata) pair, so that equal turns have one result.
    best = F.min(F.struct("turn", "metadata"))["metadata"]
    return every.groupBy("title").agg(best.alias("metadata"))


def with_metadata(papers: DataFrame, resolved: DataFrame, keys: Sequence[str] = ("ord",)) -> DataFrame:
    """Add ``Year``, ``Citation_Count`` and ``Metadata_Source``; every paper stays.

    Where ``resolved`` has failed calls, ``Metadata_Error`` names them.
    """
    found = lookup(papers, resolved, "title", spread_by=keys)
    failures = [F.col("metadata_error").alias("Metadata_Error")] if "metadata_error" in resolved.columns else []
    return found.select(
        *papers.columns,
        F.col("metadata.year").alias("Year"),
        F.coalesce("metadata.citation_count", F.lit(0).cast("bigint")).alias("Citation_Count"),
        F.coalesce("metadata.source", F.lit(NOT_FOUND)).alias("Metadata_Source"),
        *failures,
    )


def metadata_waterfall(
    papers: DataFrame, catalogs: Mapping[str, DataFrame], keys: Sequence[str] = ("ord",)
) -> DataFrame:
    """Metadata of each paper from catalog tables."""
    return with_metadata(papers, first_source(catalogs), keys)


def metadata_from_services(
    titles: DataFrame,
    services: Mapping[str, Callable[[], Callable[[str], str]]],
    order: Sequence[str] = SOURCES,
    parallelism: int | None = None,
    store: AnswerStore | None = None,
) -> DataFrame:
    """``(title, metadata, metadata_error)`` of distinct titles, asked of services in turn.

    A service sees only titles its predecessors had no hit for. A failed call is
    no hit, and its message is kept beside what a later service finds. A ``store`` keeps
    the answers of each service for later runs. Titles without hit and without failure have no row.
    """
    none = F.lit(None)
    named = titles.select("title").where(F.col("title").isNotNull()).distinct()
    pending = named.withColumn("metadata_error", none.cast("string"))
    hits: list[DataFrame] = []
    for source in order:
        if source not in services:
            continue
        kept = store.part(source) if store else None
        answers = ask(pending, "title", services[source], parallelism, store=kept)
        failed = F.concat(F.lit(f"{source}: "), F.col("error"))
        read = answers.select(
            "title",
            METADATA_PARSERS[source](F.col("result")).alias("metadata"),
            F.nullif(F.concat_ws("; ", "metadata_error", failed), F.lit("")).alias("metadata_error"),
        )
        hits.append(read.where(F.col("metadata").isNotNull()))
        pending = read.where(F.col("metadata").isNull()).select("title", "metadata_error")
    missed = pending.where(F.col("metadata_error").isNotNull()).select(
        "title", none.cast("struct<year:int,citation_count:bigint,source:string>").alias("metadata"), "metadata_error"
    )
    return reduce(DataFrame.unionByName, hits, missed)


def metadata_summary(papers: DataFrame) -> DataFrame:
    """Papers with metadata, papers in all and mean of the positive counts."""
    count = F.col("Citation_Count")
    return papers.agg(
        F.count_if(F.col("Metadata_Source") != NOT_FOUND).alias("found"),
        F.count(F.lit(1)).alias("papers"),
        F.avg(F.when(count > 0, count)).alias("avg_citations"),
    )
