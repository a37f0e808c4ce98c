"""Best-fit packing into bins of several permitted lengths.

Documents are cut into pieces no longer than the largest length. Pieces are
dealt by hash over shards of bounded size, whatever document, source or group
they come from, and each shard is packed on its own: pieces from long to short,
each into the open bin it leaves least room in. If none fits, the bin size is
opened that costs least for what it will hold. A shard is packed once for each
largest length to open, the cheapest of these is kept, and in the end each bin
shrinks to the smallest permitted length that holds its contents. Only ids and
lengths are shuffled, never texts.

Defined results: a null or empty text gives one piece of length 0 without a bin
(null). Repeated rows are packed each by itself; equal pieces are
interchangeable. Only the id and the text are read. An empty table gives no
pieces.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.durable import cut_lineage

#: Permitted sequence lengths, in UTF-8 bytes plus one for the document's end.
LENGTHS = (2048, 4096, 8192, 16384)
#: Pieces one task packs at a time.
SHARD = 50_000
#: What a bin costs besides its length.
PER_BIN = 64


def byte_length(text: Column) -> Column:
    """Tokens of a byte-level model with an end mark; 0 without text."""
    length = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return F.when(length > 0, length + 1).otherwise(F.lit(0).cast("long"))


def pieces(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    units: Callable[[Column], Column] = byte_length,
    longest: int = LENGTHS[-1],
) -> DataFrame:
    """``(key, start, n_units)``: each document in pieces of ``longest`` and a rest."""
    read = documents.select(F.col(key).alias(key), units(F.col(text)).alias("_units"))
    count = F.greatest(F.ceil(F.col("_units") / longest), F.lit(1)).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("_at")
    cut = read.select(key, "_units", starts)
    start = F.col("_at") * longest
    return cut.select(key, start.alias("start"), F.least(F.lit(longest), F.col("_units") - start).alias("n_units"))


def _pack(sizes: Sequence[int], lengths: Sequence[int], cost: dict[int, float]) -> tuple[list[int], list[int], list[int], float]:
    """Bin and offset of each size (in falling order), each bin's final length, the cost."""
    levels: list[int] = []  # rooms that some open bin has, rising
    waiting: dict[int, list[int]] = {}
    room: list[int] = []
    opened: list[int] = []
    bins, offsets = [], []
    rest = sum(sizes)
    for size in sizes:
        at = bisect.bisect_left(levels, size)
        if at < len(levels):
            level = levels[at]
            chosen = waiting[level].pop()
            if not waiting[level]:
                del waiting[level]
                levels.pop(at)
        else:
            chosen = len(room)
            fitting = [n for n in lengths if n >= size]
            length = min(fitting, key=lambda n: (cost[n] / min(n, rest), -n))
            room.append(length)
            opened.append(length)
        bins.append(chosen)
        offsets.append(opened[chosen] - room[chosen])
        room[chosen] -= size
        rest -= size
        left = room[chosen]
        if left:
            if left not in waiting:
                waiting[left] = []
                bisect.insort(levels, left)
            waiting[left].append(chosen)
    final = [next(n for n in lengths if n >= opened[b] - room[b]) for b in range(len(room))]
    # A shrunken bin keeps its contents' offsets: they start at 0.
    return bins, offsets, final, sum(cost[n] for n in final)


def best_fit(
    sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: dict[int, float] | None = None
) -> tuple[list[int], list[int], list[int]]:
    """Packs sizes given in falling order: bins, offsets, length of each bin.

    Tries every largest length to open; a piece longer than that opens the
    smallest length it fits in.
    """
    lengths = sorted(lengths)
    cost = cost or {n: n + PER_BIN for n in lengths}
    best = None
    for top in lengths:
        need = next((n for n in lengths if not sizes or n >= sizes[0]), lengths[-1])
        allowed = [n for n in lengths if n <= max(top, need)]
        packed = _pack(sizes, allowed, cost)
        if best is None or packed[3] < best[3]:
            best = packed
    return best[:3]


def pack(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    units: Callable[[Column], Column] = byte_length,
    lengths: Sequence[int] = LENGTHS,
    cost: dict[int, float] | None = None,
    shard: int = SHARD,
) -> DataFrame:
    """``(key, start, n_units, bin_id, bin_length, bin_offset)``, a row per piece."""
    lengths = tuple(sorted(lengths))
    cut = cut_lineage(pieces(documents, key=key, text=text, units=units, longest=lengths[-1]), "pieces")
    shards = max(1, -(-cut.count() // shard))
    # By content, so that a repeated run deals the same. Copies of one piece, which
    # mixing makes, are numbered first: many of them must not meet in one shard.
    copies = Window.partitionBy(key, "start", "n_units").orderBy(F.lit(0))
    numbered = cut.withColumn("_copy", F.row_number().over(copies))
    spread = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col("start"), F.col("_copy")), F.lit(shards)).cast("long")
    kind = dict(cut.dtypes)[key]

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["_shard"].iloc[0]) if len(frame) else 0
        frame = frame.sort_values(["n_units", key, "start"], ascending=[False, True, True], kind="stable")
        sizes = [n for n in frame["n_units"].tolist() if n > 0]
        bins, offsets, final = best_fit(sizes, lengths, cost)
        empty = len(frame) - len(sizes)
        base = number << 32
        return pd.DataFrame(
            {
                key: frame[key].array,
                "start": frame["start"].to_numpy(),
                "n_units": frame["n_units"].to_numpy(),
                "bin_id": pd.array([base + b for b in bins] + [None] * empty, dtype="Int64"),
                "bin_length": pd.array([final[b] for b in bins] + [None] * empty, dtype="Int64"),
                "bin_offset": pd.array(list(offsets) + [None] * empty, dtype="Int64"),
            }
        )

    schema = f"`{key}` {kind}, start long, n_units long, bin_id long, bin_length long, bin_offset long"
    return numbered.withColumn("_shard", spread).groupBy("_shard").applyInPandas(packed, schema)
