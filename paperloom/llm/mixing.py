"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times each of its documents should be
repeated: its target share of the mixture over its own size. A document's count
is the inverse of the Poisson distribution with that mean at a number in (0, 1)
drawn from a hash of the seed and the document's id, so that it depends neither
on the order nor on the placing of rows and a lost task draws the same again. A mean above
``TABLED`` is dealt over independent draws of an equal, smaller mean: their sum is
Poisson with the whole.

Sizes are summed in each partition before the shuffle. The distribution is
tabled once per source; a document only looks its number up. Rates join by
broadcast up to ``BROADCAST_SOURCES`` sources, beyond that by a plain join
whose hot keys adaptive execution splits. Copies leave through one shuffle by a
hash of id and copy, which is even however large one source is.

Defined results: a null source is a source of its own. A null or empty text has
size 0 and is repeated like any other of its source; a source without any text
keeps its documents at the rate ``epochs``. Repeated rows of one id draw the
same count each. Added columns replace those of the same name. An empty table
gives an empty mixture. ``max_rate``, if given, bounds how often a source is repeated
on average, as a limit on epochs: a source it holds back misses its weight and the
mixture is smaller. No row is dropped for it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.sources.durable import cut_lineage

BROADCAST_SOURCES = 10_000
#: The largest mean that is tabled: e to the power -mean stays far from 0.
TABLED = 100.0
#: Copies of a document that leave together where there can be many.
CHUNK = 10_000
#: 13 hexadecimal digits of an MD5: 52 bits, exact in a double.
DIGITS = 13


def _drawn(seed: str, *parts: Column) -> Column:
    """A whole number below 2^52 from the parts."""
    named = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def rates(
    documents: DataFrame,
    *,
    source: str = "source",
    text: str = "text",
    weights: Mapping[str | None, float] | None = None,
    temperature: float = 0.7,
    epochs: float = 1.0,
    max_rate: float | None = None,
) -> DataFrame:
    """``(source_key, size, rate, draws, cdf)`` per source.

    ``weights`` are relative; sources without one get none. Without ``weights`` a
    source's weight is its size to the power ``temperature``. The mixture is
    ``epochs`` times as large as the input. ``cdf[k]`` is the probability of at
    most ``k`` copies in one of ``draws`` draws, up to where it is 1 in double precision.
    """
    sizes = documents.groupBy(F.col(source).alias("source_key")).agg(
        F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("size")
    )
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source_key").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sizes = cut_lineage(sizes.withColumn("weight", weight), "sizes")
    # One row: the sum over the sources.
    total = sizes.where("size > 0").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") * F.lit(float(epochs) * float(total["size"] or 0)) / F.lit(float(total["weight"] or 1) or 1.0)
    reached = share / F.col("size")
    if max_rate is not None:
        reached = F.least(reached, F.lit(float(max_rate)))
    rate = F.when(F.col("size") > 0, reached).otherwise(F.lit(float(epochs)))
    rated = sizes.select("source_key", "size", rate.alias("rate"))
    rated = rated.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / TABLED)).cast("long"))
    rated = rated.withColumn("part", F.col("rate") / F.col("draws"))
    last = F.ceil(F.col("part") + 12 * F.sqrt("part") + 20).cast("int")
    begun = F.struct(
        F.exp(-F.col("part")).alias("p"), F.array(F.exp(-F.col("part"))).alias("cdf")
    )

    def more(table: Column, k: Column) -> Column:
        p = table["p"] * F.col("part") / k
        return F.struct(p.alias("p"), F.concat(table["cdf"], F.array(F.element_at(table["cdf"], -1) + p)).alias("cdf"))

    tabled = F.aggregate(F.sequence(F.lit(1), last), begun, more)["cdf"]
    return rated.select("source_key", "size", "rate", "draws", tabled.alias("cdf"))


def _replicated(documents: DataFrame, rated: DataFrame, *, key: str, source: str, seed: str) -> DataFrame:
    """``(row, n_copies, copy, mix_key)``: whole documents, in a global random order."""
    table = rated.select("source_key", "cdf", "draws")
    known = rated.agg(F.count(F.lit(1)).alias("sources"), F.max("draws").alias("draws")).first()
    if known["sources"] <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    drawn = (_drawn(seed, F.col(key)) + 0.5) / float(1 << 4 * DIGITS)
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    asked = documents.select(
        whole.alias("row"), F.col(key).alias("key"), drawn.alias("drawn"), F.col(source).alias("source")
    )
    joined = asked.join(table, F.col("source").eqNullSafe(F.col("source_key")))
    n_copies = F.size(F.filter("cdf", lambda c: c < F.col("drawn"))).cast("long")
    first, last = F.lit(1).cast("long"), F.col("n_copies")
    if (known["draws"] or 1) == 1:
        counted = joined.select("row", "key", n_copies.alias("n_copies")).where("n_copies > 0")
    else:

        def more(copies: Column, draw: Column) -> Column:
            u = (_drawn(seed + "-draw", F.col("key"), draw) + 0.5) / float(1 << 4 * DIGITS)
            return copies + F.size(F.filter("cdf", lambda c: c < u))

        several = F.aggregate(F.sequence(F.lit(2).cast("long"), F.col("draws")), n_copies, more)
        n_copies = F.when(F.col("draws") > 1, several).otherwise(n_copies)
        counted = joined.select("row", "key", n_copies.alias("n_copies")).where("n_copies > 0")
        # The copies of one document leave from several tasks.
        chunks = F.sequence(F.lit(0).cast("long"), F.floor((last - 1) / CHUNK))
        counted = counted.select("row", "key", "n_copies", F.explode(chunks).alias("chunk"))
        counted = counted.repartition(F.xxhash64("key", "chunk"))
        first = F.col("chunk") * CHUNK + 1
        last = F.least(last, first + (CHUNK - 1))
    copied = counted.select("row", "key", "n_copies", F.explode(F.sequence(first, last)).alias("copy"))
    keyed = copied.select("row", "n_copies", "copy", _drawn(seed + "-order", F.col("key"), F.col("copy")).alias("mix_key"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def replicate(
    documents: DataFrame, rated: DataFrame, *, key: str = "doc_id", source: str = "source", seed: str = "mixture"
) -> DataFrame:
    """Documents repeated by their counts, in a global random order.

    Adds ``copy`` (from 1), ``n_copies`` and ``mix_key``, by which each partition
    is sorted, in place of columns of these names; sorting all rows by it gives one
    order for any number of partitions.
    """
    own = [c for c in documents.columns if c not in ("copy", "n_copies", "mix_key")]
    out = _replicated(documents, rated, key=key, source=source, seed=seed)
    return out.select(*[F.col(f"row.`{c}`") for c in own], "n_copies", "copy", "mix_key")


def mix(documents: DataFrame, *, seed: str = "mixture", **options) -> DataFrame:
    """``replicate`` with the ``rates`` of the documents themselves."""
    return replicate(documents, rates(documents, **options), seed=seed)


def mix_rows(documents: DataFrame, *, seed: str = "mixture", **options) -> DataFrame:
    """The documents of ``mix`` with their own columns only, whatever their names."""
    out = _replicated(documents, rates(documents, **options), key="doc_id", source="source", seed=seed)
    return out.select("row.*")


MIX_SQL = """
with recursive sizes as (
  select source as source_key, sum(coalesce(length(text), 0)) as size from documents group by source),
total as (select sum(size) as size, sum(pow(size, 0.7)) as weight from sizes where size > 0),
rated as (
  select source_key, case when s.size > 0
    then pow(s.size, 0.7) * cast(t.size as double) / t.weight / s.size else 1.0 end as rate
  from sizes s, total t),
cdf as (
  select source_key, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from rated
  union all
  select source_key, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from cdf
  where k < ceil(rate + 12 * sqrt(rate) + 20)),
drawn as (
  select *, (cast('0x' || substr(md5('mixture|' || doc_id), 1, 13) as bigint) + 0.5) / 4503599627370496.0 as u
  from documents),
counted as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, count(c.k) as n_copies
  from drawn d join cdf c on d.source is not distinct from c.source_key and c.c < d.u
  group by d.doc_id, d.text, d.lang, d.source, d.n_chars)
select doc_id, text, lang, source, n_chars, n_copies, copy,
  cast('0x' || substr(md5('mixture-order|' || doc_id || '|' || copy), 1, 13) as bigint) as mix_key
from counted, unnest(generate_series(1, n_copies)) g(copy)
"""
