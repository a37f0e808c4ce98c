"""Connected components of links, and joins with sets of ids of unknown size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.sources.durable import cut_lineage

#: Ids that may be broadcast: 8 MB as longs, 16 MB with hashes.
BROADCAST_IDS = 1_000_000


def unused(rows: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``rows`` has it."""
    taken = {column.lower() for column in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_ids(rows: DataFrame, ids: DataFrame, key: str, how: str, *, text: str | None = None) -> DataFrame:
    """Semi or anti join of ``rows`` with the written table ``ids``, null-safe.

    With ``text``, a row must also have the ``hash`` of its text there. Few ids go to the rows, so that texts stay where they are; beyond
    BROADCAST_IDS the rows are shuffled.
    """
    own, hashed = unused(rows, "_id"), unused(rows, "_hash")
    names = [F.col(key).alias(own)] + ([F.col("hash").alias(hashed)] if text else [])
    found = ids.select(*names).distinct()
    if ids.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    same = F.col(key).eqNullSafe(F.col(own))
    if text:
        same &= F.xxhash64(text) == F.col(hashed)
    return rows.join(found, same, how)


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs to one node only, which itself hangs to none."""
    hanging = edges.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    holding = edges.select(F.col("b").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below"))
    roles = hanging.union(holding).groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return roles.where("above + below > 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges (a, b)``; a component is its least node.

    Alternating large and small stars: each round hangs all neighbours of a node
    to the least of them, so the number of rounds grows with the logarithm of a
    chain's length. A node's neighbours are never gathered: their least comes
    from an aggregate combined before the shuffle, and reaches them by a join.
    Every round is written to the shared folder. Edges that are stars already are
    the result: no round is spent on seeing that nothing changes.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges, "edges")
    while not _stars(edges):
        # Large star: neighbours above a node go to the least around it.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: neighbours below a node, and the node, go to the least of them.
        down = cut_lineage(large.where("a <> b").distinct(), "edges")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
    # At the end every node hangs to its component's least node.
    tops = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        tops.select("node", F.col("node").alias("component"))
    )
