"""Bounded samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 40


def thinned(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """About ``n`` of the rows, by a hash of the columns: the same in any order.

    All rows where there are no more. What a later limit collects from each task
    then does not grow with the number of tasks.
    """
    share = min(1.0, n / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(*columns), F.lit(_RANGE)) < int(share * _RANGE))


def least(rows: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """``(h, text)``: the whole texts of the ``n`` rows of least hash ``h``; equal rows count once.

    Only hashes come to the driver, and only chosen rows are shuffled.
    """
    hashed = rows.where(F.col(text).isNotNull()).select(
        F.xxhash64(F.col(key).cast("string")).alias("h"), F.xxhash64(text).alias("hh"), F.col(text).alias("text")
    )
    first = hashed.select("h", "hh").distinct().orderBy("h", "hh").limit(n).collect()
    if not first:
        return hashed.select("h", "text").limit(0)
    h, hh = first[-1]
    chosen = hashed.where((F.col("h") < h) | ((F.col("h") == h) & (F.col("hh") <= hh)))
    return chosen.dropDuplicates(["h", "hh"]).select("h", "text")
