"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows are counted in this many buckets of keys, whatever the number of keys.
BUCKETS = 1 << 18
# A bucket is split once it holds more than this share of all rows (over ten times
# the mean), and never below this many rows. There can be at most 1 / HOT_SHARE
# such buckets, which bounds the list of them, and their salts come to at most
# 2 / HOT_SHARE; as table rows are spread over all buckets by hash, about
# 2 / HOT_SHARE / BUCKETS of them, a sixth, are copied at worst.
HOT_SHARE = 5e-5
HOT_ROWS = 100_000

# Bits a wanted key has in a filter, words of 64 bits for one key, and most words.
FILTER_BITS = 4
FILTER_SHARE = 0.25
FILTER_WORDS = 1 << 20


def bucket(key: Column) -> Column:
    return F.pmod(key, F.lit(BUCKETS))


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """``(_key, _n)``: rows per bucket of ``key``. A partition sends at most one
    row per bucket on, not one per key; a bucket is never less than its keys."""
    return rows.groupBy(bucket(F.xxhash64(key)).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))


def hot_keys(counts: DataFrame, share: float = HOT_SHARE, min_rows: int = HOT_ROWS) -> list[tuple[int, int]]:
    """Each hot bucket and how many parts to cut it into; at most ``1 / share``
    entries. ``counts`` may be finer, by hash of the key."""
    buckets = counts.groupBy(bucket(F.col("_key")).alias("_key")).agg(F.sum("_n").alias("_n"))
    total = buckets.agg(F.sum("_n")).scalar()
    limit = F.greatest(total * F.lit(share), F.lit(float(min_rows)))
    hot = buckets.select("_key", "_n", limit.alias("_limit")).where(F.col("_n") > F.col("_limit"))
    return [tuple(row) for row in hot.select("_key", F.ceil(F.col("_n") / F.col("_limit"))).collect()]


def _word(key: str, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("word"), key), F.lit(words))


def _mask(key: str) -> Column:
    """The bits of a key in its word."""
    bits = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("bigint")
    for i in range(FILTER_BITS):
        # The number of places to shift by is a column, so it takes SQL.
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def prefilter(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``table``; none that
    is in it is lost, rows with a NULL key are.

    A Bloom filter in blocks: the hash of a key names a word of 64 bits and four
    bits of it. Words are put together in the tasks and broadcast; there are about
    a quarter as many as keys, and never more than ``FILTER_WORDS`` (two longs
    each), so for very many keys more rows pass, but the filter does not grow. It
    is a semi join, as the optimizer moves later semi joins below other joins.
    """
    known = table.where(F.col(key).isNotNull())
    wanted = known.agg(F.approx_count_distinct(key)).first()[0]
    words = min(FILTER_WORDS, max(64, int(wanted * FILTER_SHARE)))
    filled = known.groupBy(_word(key, words).alias("_word")).agg(F.bit_or(_mask(key)).alias("_mask"))
    probed = rows.where(F.col(key).isNotNull()).withColumns({"_own_word": _word(key, words), "_bits": _mask(key)})
    hit = (F.col("_own_word") == F.col("_word")) & (F.col("_mask").bitwiseAND(F.col("_bits")) == F.col("_bits"))
    return probed.join(F.broadcast(filled), hit, "left_semi").drop("_own_word", "_bits")


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    spread_by: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
    share: float = HOT_SHARE,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``table``, which has at most one row per key.

    Rows are counted first, by bucket of the key's hash, reading the key column
    only; ``counts`` by 64-bit hash of the key saves that where the caller knows.
    Without hot buckets this is the plain join. Otherwise rows of a hot one are
    dealt over several salts by the hash of ``spread_by`` and its table rows are
    copied once per salt; all other keys have salt 0. Spark picks the join
    strategy from the sizes it knows.
    """
    hot = hot_keys(key_counts(rows, key) if counts is None else counts, share, min_rows)
    if not hot:
        return rows.join(table, key, how)
    listed = F.broadcast(rows.sparkSession.createDataFrame(hot, "_key bigint, _salts bigint"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_salts")), F.lit(0).cast("bigint"))
    dealt = (
        rows.withColumn("_key", bucket(F.xxhash64(key)))
        .join(listed, "_key", "left")
        .withColumn("_salt", salt)
        .drop("_key", "_salts")
    )
    last = F.coalesce(F.col("_salts"), F.lit(1).cast("bigint")) - 1
    copied = (
        table.withColumn("_key", bucket(F.xxhash64(key)))
        .join(listed, "_key", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .drop("_key", "_salts")
    )
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
