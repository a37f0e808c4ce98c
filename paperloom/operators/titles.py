"""Metadata by title where titles are spelled a little differently.

Titles are compared by a key: letters and digits in lower case, all else one space.
Keys that are not equal still match within a few edits, found without comparing all
pairs: a catalog key with ``d`` edits to spare is cut into ``d + 1`` even pieces, of
which at least one stands unchanged in any key within ``d`` edits, shifted by at most
``d`` places. So catalog keys are entered by length, number and text of each piece,
and a title looks up the few places a piece could stand in it. The distance is tested
in the condition of that join, so only matches leave it, and none is missed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.answers import SOURCES
from paperloom.functions.text import title_key
from paperloom.operators.lookup import lookup
from paperloom.operators.metadata import with_metadata

#: Characters of a catalog key for each edit to spare, and the most edits.
CHARS_PER_EDIT = 8
MAX_EDITS = 2


def _edits(length: str, most: int) -> str:
    """SQL: the edits a catalog key of this length has to spare."""
    return f"least({most}, {length} div {CHARS_PER_EDIT})"


def _piece_start(length: str, number: str, most: int) -> str:
    """SQL: where a piece of a catalog key begins, from 0; later pieces take what is left over."""
    pieces = f"({_edits(length, most)} + 1)"
    return f"({number} * ({length} div {pieces}) + greatest(0, {number} - ({pieces} - {length} % {pieces})))"


def _piece_length(length: str, number: str, most: int) -> str:
    return f"({_piece_start(length, f'({number} + 1)', most)} - {_piece_start(length, number, most)})"


def entries(keys: DataFrame, most: int = MAX_EDITS) -> DataFrame:
    """``(held, size, number, piece)`` of catalog keys ``key`` that have edits to spare."""
    sized = keys.select(F.col("key").alias("held"), F.length("key").alias("size"))
    numbered = sized.withColumn("number", F.expr(f"explode(sequence(0, {_edits('size', most)}))"))
    piece = f"substring(held, {_piece_start('size', 'number', most)} + 1, {_piece_length('size', 'number', most)})"
    return numbered.where(F.expr(_edits("size", most)) > 0).withColumn("piece", F.expr(piece))


def lookups(keys: DataFrame, most: int = MAX_EDITS) -> DataFrame:
    """``(key, size, number, piece)``: every place a piece of a catalog key within reach could stand in ``key``."""
    sized = keys.select("key", F.length("key").alias("own"))
    sized = sized.withColumn("size", F.explode(F.sequence(F.col("own") - most, F.col("own") + most)))
    sized = sized.where(F.expr(_edits("size", most)) > 0)
    numbered = sized.withColumn("number", F.expr(f"explode(sequence(0, {_edits('size', most)}))"))
    edits = _edits("size", most)
    shifted = numbered.withColumn("shift", F.expr(f"explode(sequence(-{edits}, {edits}))"))
    start, length = _piece_start("size", "number", most), _piece_length("size", "number", most)
    shifted = shifted.withColumn("start", F.expr(start) + F.col("shift")).withColumn("length", F.expr(length))
    inside = shifted.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("own")))
    return inside.select("key", "size", "number", F.expr("substring(key, start + 1, length)").alias("piece")).distinct()


def near_keys(keys: DataFrame, catalog: DataFrame, most: int = MAX_EDITS) -> DataFrame:
    """``(key, held, distance)`` of different keys within the edits that ``held``, from the catalog, has to spare."""
    distance = F.levenshtein("key", "held", most)
    near = distance.between(1, F.expr(_edits("l.size", most)))
    one, other = lookups(keys, most).alias("k"), entries(catalog, most).alias("l")
    same = [F.col(f"k.{name}") == F.col(f"l.{name}") for name in ("size", "number", "piece")]
    pairs = one.join(other, reduce(Column.__and__, same) & near)
    return pairs.select("key", "held").distinct().withColumn("distance", distance)


def best_hits(
    titles: DataFrame, catalogs: Mapping[str, DataFrame], order: Sequence[str] = SOURCES, most: int = MAX_EDITS
) -> DataFrame:
    """``(key, metadata)``: the best hit of the first source that has any, for each title's key.

    Within a source an equal key is best, then fewer edits, then the lesser key.
    Catalogs are those of ``metadata.first_source``.
    """

    def labelled(place: int, source: str) -> DataFrame:
        catalog = catalogs[source]
        rank = F.col("rank") if "rank" in catalog.columns else F.lit(0)
        found = [F.col("year").cast("int").alias("year"), F.col("citation_count").cast("bigint").alias("citation_count")]
        metadata = F.struct(*found, F.lit(source).alias("source"))
        best = F.min(F.struct(rank.cast("bigint").alias("rank"), metadata.alias("metadata")))["metadata"]
        keyed = catalog.withColumn("held", title_key(F.col("title"))).where(F.col("held").isNotNull())
        return keyed.groupBy("held").agg(best.alias("metadata")).withColumn("place", F.lit(place))

    held = reduce(DataFrame.unionByName, [labelled(i, name) for i, name in enumerate(order) if name in catalogs])
    keys = titles.select(title_key(F.col("title")).alias("key")).where(F.col("key").isNotNull()).distinct()
    same = keys.join(held.withColumnRenamed("held", "key"), "key")
    same = same.select("key", "place", F.lit(0).alias("distance"), F.col("key").alias("held"), "metadata")
    near = near_keys(keys, held.select(F.col("held").alias("key")).distinct(), most)
    near = near.join(held, "held").select("key", "place", "distance", "held", "metadata")
    hit = F.struct("place", "distance", "held", "metadata")
    return same.unionByName(near).groupBy("key").agg(F.min(hit)["metadata"].alias("metadata"))


def metadata_by_title(
    papers: DataFrame,
    catalogs: Mapping[str, DataFrame],
    keys: Sequence[str] = ("ord",),
    order: Sequence[str] = SOURCES,
    most: int = MAX_EDITS,
) -> DataFrame:
    """``metadata.metadata_waterfall`` for titles that are spelled differently; ``most`` 0 leaves equal keys only."""
    resolved = best_hits(papers, catalogs, order, most)
    titles = papers.select("title").distinct().withColumn("key", title_key(F.col("title")))
    by_title = lookup(titles, resolved, "key", ["title"]).where(F.col("metadata").isNotNull())
    return with_metadata(papers, by_title.select("title", "metadata"), keys)
