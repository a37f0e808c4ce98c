"""Repeated byte strings, found bucket by bucket, and the texts without them.

A string of LENGTH bytes counts as repeated if it also starts earlier: in a
smaller document id, or before it in the same document. The suffixes that matter
are the starts of such strings, cut at LENGTH bytes; they are never rows.

1. Every start belongs to a bucket by content: the least-hashed SEED bytes within
   its string. Equal strings have equal buckets at equal offsets. All starts that
   one occurrence of a seed owns make one run, about one row per 35 bytes.
2. Runs with the same bytes throughout need no sorting: all but the first are
   repeats as a whole. A batch settles its own before the shuffle, so a passage
   that most documents share leaves each task once.
3. What is left are buckets with several different runs: the edges of repeated
   passages. Each such bucket is sorted at a time. Offsets from the seed that lie
   in a difference cover modulo PERIOD are ranked first, by the bytes that follow
   (REACH of them); a suffix is then ordered by its few bytes up to the next cover
   sample, that sample's rank, and the few bytes behind: long ties are never
   compared byte by byte again, and ranks exist for the cover only.
4. A bucket with more than HOT runs does not go to one task: its strings are
   hashed and their first starts found by an aggregate.
5. Repeated starts become ranges, merged per document by windows over ids and
   ends; texts meet them by broadcast while there are few, else by a join.

Defined results: a null or empty text has no bytes and nothing removed. Rows of
one id and text are one document, and each gets its row; texts of one id are
ordered by their hash. Null ids come first. Only id and text are read. An empty
table gives an empty result. Strings are compared exactly, but for 64-bit hashes
of whole runs and of the strings of hot buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import shingles as S
from paperloom.sources.durable import cut_lineage

LENGTH = 100
SEED = 32
#: Seeds within one string.
SEEDS = LENGTH - SEED + 1
#: A perfect difference set: any two residues differ from two members by the same shift.
PERIOD = 13
COVER = (0, 1, 3, 9)
#: Bytes a cover sample is ranked by: what every string has behind its first sample.
REACH = LENGTH - PERIOD + 1
#: Bytes of a text that are looked at together.
PIECE = 1 << 20
#: Runs of one bucket that one task sorts, and rows that may be broadcast.
HOT = 100_000
BROADCAST = 1_000_000
#: Bytes around a seed that its strings can reach.
LEFT = SEEDS - 1
WIDE = LEFT + LENGTH

_RANDOM = S.mix((np.arange(256, dtype=np.uint64) + np.uint64(1000)) * np.uint64(0x9E3779B97F4A7C15))
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from running minima within blocks."""
    n = len(key) - width + 1
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts in ``data``: text, first start, number of starts, seed's place from there, bucket, hash of all bytes."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    up, down = S.tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[data] * up[:n], out=total[1:])
    seeds = S.mix((total[SEED:] - total[: n - SEED + 1]) * down[: n - SEED + 1])
    key = (seeds & _HIGH) | np.arange(len(seeds), dtype=np.uint64)
    owner = (_least(key, SEEDS) & _LOW).astype(np.int64)
    whole = np.ones(len(owner), dtype=bool)
    for end in offsets[1:-1].tolist():
        whole[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(whole)
    if len(starts) == 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    owner = owner[starts]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    low, seed = starts[first], owner[first]
    count = np.diff(np.r_[first, len(starts)])
    end = low + count + LENGTH - 1
    shape = (((seed - low) << 8) | count).astype(np.uint64)
    content = S.mix((total[end] - total[low]) * down[low] + S.mix(shape))
    text = np.searchsorted(offsets, low, side="right") - 1
    return text, low - offsets[text], count, seed - low, seeds[seed].view(np.int64), content.view(np.int64)


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts, long texts in overlapping pieces: first text, bytes before, bytes, offsets."""
    for at, data, offsets in S.parts(column, PIECE // 2):
        if len(data) <= PIECE:
            yield at, 0, data, offsets
            continue
        for low in range(0, max(1, len(data) - LENGTH + 1), PIECE):
            part = data[low : low + PIECE + LENGTH - 1]
            yield at, low, part, np.array([0, len(part)])


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any of the columns."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


_RUN = "kind int, bucket long, content long, doc long, uid long, span long"
_NAMES = ["kind", "bucket", "content", "doc", "uid", "span"]


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, columns)], names=_NAMES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each batch: 0 for the first of its bytes in the batch, 1 for later ones."""
    for batch in batches:
        docs, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = []
        for at, before, data, offsets in _pieces(batch.column(2)):
            text, low, count, place, bucket, content = runs(data, offsets)
            found.append((bucket, content, text + at, ((low + before) << 16) | (place << 8) | count))
        if not found:
            continue
        bucket, content, text, span = (np.concatenate(c) for c in zip(*found))
        doc, uid = docs[text], uids[text]
        order = np.lexsort((span, uid, doc, content, bucket))
        bucket, content, doc, uid, span = (c[order] for c in (bucket, content, doc, uid, span))
        once = _fresh(bucket, content, doc, uid, span)
        bucket, content, doc, uid, span = (c[once] for c in (bucket, content, doc, uid, span))
        first = _fresh(bucket, content)
        yield _rows(0, *(c[first] for c in (bucket, content, doc, uid, span)))
        yield _rows(1, *(c[~first] for c in (bucket, content, doc, uid, span)))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket, bytes and place: 1 for later runs of the same
    bytes, 2 for the first of theirs in buckets with several. Holds one batch."""
    last: tuple[int, ...] | None = None  # the row before
    waiting: tuple[np.ndarray, ...] | None = None  # the last first run, and whether it is told already
    told = False
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(6)]
        done = columns[0] == 1
        if done.any():
            yield _rows(1, *(c[done] for c in columns[1:]))
        rows = [c[~done] for c in columns[1:]]
        if len(rows[0]) == 0:
            continue
        once = _fresh(*rows)
        again = ~_fresh(rows[0], rows[1])
        if last is not None:
            once[0] = tuple(int(c[0]) for c in rows) != last
            again[0] = tuple(int(c[0]) for c in rows[:2]) == last[:2]
        last = tuple(int(c[-1]) for c in rows)
        later = again & once
        if later.any():
            yield _rows(1, *(c[later] for c in rows))
        firsts = [c[~again] for c in rows]
        if waiting is not None:
            firsts = [np.r_[w, c] for w, c in zip(waiting, firsts)]
        if len(firsts[0]) == 0:
            continue
        same = ~_fresh(firsts[0])
        several = same.copy()
        several[:-1] |= same[1:]
        if told:
            several[0] = False
        told_last = bool(several[-1]) or (told and len(several) == 1)
        if several.any():
            yield _rows(2, *(c[several] for c in firsts))
        waiting, told = tuple(c[-1:] for c in firsts), told_last


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """From each offset to the next one in the cover."""
    return np.array([next(d for d in range(PERIOD) if (o + d) % PERIOD in COVER) for o in range(LEFT + 1)])


def sort_buckets(bucket: np.ndarray, near: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which starts repeat an earlier one, as a table of runs by offsets before the seed.

    ``near`` has WIDE bytes per run with the seed at LEFT; rows are in order of
    document and place. Column ``o`` is the start at offset ``o`` of ``near``.
    """
    n = len(bucket)
    repeated = np.zeros((n, LEFT + 1), dtype=bool)
    near = np.ascontiguousarray(near)
    first = LEFT - place  # offset of the first start a run owns
    ranks: dict[int, np.ndarray] = {}
    group = np.unique(bucket, return_inverse=True)[1].astype(np.int64)
    shifts = _shifts()
    for offset in range(LEFT + 1):
        held = np.flatnonzero((first <= offset) & (offset < first + count))
        if len(held) < 2:
            continue
        shift = int(shifts[offset])
        sample = offset + shift
        if sample not in ranks:
            ahead = np.ascontiguousarray(near[:, sample : sample + REACH]).view(f"V{REACH}").ravel()
            ranks[sample] = np.unique(ahead, return_inverse=True)[1].astype(np.int64)
        key = np.empty((len(held), 16 + PERIOD - 1), dtype=np.uint8)
        key[:, :8] = group[held].view(np.uint8).reshape(-1, 8)
        key[:, 8:16] = ranks[sample][held].view(np.uint8).reshape(-1, 8)
        key[:, 16 : 16 + shift] = near[held, offset:sample]
        key[:, 16 + shift :] = near[held, sample + REACH : offset + LENGTH]
        _, earliest, which = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_index=True, return_inverse=True)
        repeated[held, offset] = earliest[which] != np.arange(len(held))
    return repeated


def _ranges(doc, uid, low, place, count, repeated) -> pa.RecordBatch:
    """Repeated starts of each run as ranges of bytes."""
    n, width = repeated.shape
    edge = np.zeros((n, width + 2), dtype=np.int8)
    edge[:, 1:-1] = repeated
    change = np.diff(edge, axis=1)
    row, begin = np.nonzero(change == 1)
    _, after = np.nonzero(change == -1)
    start = low[row] + begin - (LEFT - place[row])
    columns = [doc[row], uid[row], start, start + (after - begin) + LENGTH - 1]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "uid", "start", "end"])


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts whole buckets out of rows sorted by bucket; holds one bucket or one batch."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        bucket, doc, uid, span = (rows.column(c).to_numpy() for c in ("bucket", "doc", "uid", "span"))
        near = np.frombuffer(b"".join(rows.column("near").to_pylist()), dtype=np.uint8).reshape(-1, WIDE)
        order = np.lexsort((span, uid, doc))
        bucket, doc, uid, span, near = bucket[order], doc[order], uid[order], span[order], near[order]
        place, count = span >> 8 & 255, span & 255
        return _ranges(doc, uid, span >> 16, place, count, sort_buckets(bucket, near, place, count))

    for batch in batches:
        buckets = batch.column(0).to_numpy()
        if len(buckets) == 0:
            continue
        held.append(batch)
        cut = int(np.searchsorted(buckets, buckets[-1]))
        if cut:
            yield done(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        elif len(held) > 1 and held[-2].column(0)[-1].as_py() != int(buckets[0]):
            yield done(pa.Table.from_batches(held[:-1]))
            held = [batch]
    if held:
        yield done(pa.Table.from_batches(held))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every string that the runs own."""
    for batch in batches:
        doc, uid, span = (batch.column(i).to_numpy() for i in (1, 2, 3))
        near = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(-1, WIDE)
        place, count = span >> 8 & 255, span & 255
        up, down = S.tables(WIDE + 1)
        total = np.zeros((len(near), WIDE + 1), dtype=np.uint64)
        np.cumsum(_RANDOM[near] * up[:WIDE], axis=1, out=total[:, 1:])
        value = S.mix((total[:, LENGTH:] - total[:, : LEFT + 1]) * down[: LEFT + 1])
        offset = np.arange(LEFT + 1)
        first = (LEFT - place)[:, None]
        row, at = np.nonzero((first <= offset) & (offset < first + count[:, None]))
        start = (span >> 16)[row] + at - (LEFT - place[row])
        columns = [value[row, at].view(np.int64), doc[row], uid[row], start]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["string", "doc", "uid", "start"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the seeds of listed runs of each text."""
    for batch in batches:
        data, offsets = S.buffers(batch.column(2))
        lists, uids, docs = batch.column(3), batch.column(1).to_numpy(), batch.column(0).to_numpy()
        for i in range(len(batch)):
            text = np.zeros(LEFT + (offsets[i + 1] - offsets[i]) + LENGTH, dtype=np.uint8)
            text[LEFT : LEFT + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
            items = lists[i].values
            bucket, span = items.field(0).to_numpy(), items.field(1).to_numpy()
            seed = (span >> 16) + (span >> 8 & 255)
            near = text[seed[:, None] + np.arange(WIDE)]
            column = pa.Array.from_buffers(
                pa.binary(), len(near), [None, pa.py_buffer(np.arange(0, near.size + 1, WIDE, dtype=np.int32)), pa.py_buffer(near.tobytes())]
            )
            n = len(near)
            columns = [pa.array(bucket), pa.array(np.full(n, docs[i])), pa.array(np.full(n, uids[i])), pa.array(span), column]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "doc", "uid", "span", "near"])


def _first_id(key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long"))


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST else rows


def repeated_ranges(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, uid, start, end)``: merged ranges of bytes covered by repeated strings."""
    read = documents.select(_first_id(key).alias("doc"), F.xxhash64(F.col(text)).alias("uid"), F.col(text).alias("text"))
    cut = read.mapInArrow(_cut, _RUN)
    dealt = F.when(F.col("kind") == 1, F.xxhash64("doc", "uid", "span")).otherwise(F.col("bucket"))
    sorted_runs = cut.repartition(dealt).sortWithinPartitions("bucket", "content", "doc", "uid", "span")
    settled = cut_lineage(sorted_runs.mapInArrow(_settle, _RUN).drop("content"), "runs")
    low = F.shiftright("span", 16)
    whole = settled.where("kind = 1").select(
        "doc", "uid", low.alias("start"), (low + F.col("span").bitwiseAND(F.lit(255)) + (LENGTH - 1)).alias("end")
    )

    open_runs = settled.where("kind = 2").select("bucket", "doc", "uid", "span")
    listed = open_runs.groupBy("doc", "uid").agg(F.collect_list(F.struct("bucket", "span")).alias("runs"))
    texts = read.join(_small(listed, open_runs.count()), ["doc", "uid"]).dropDuplicates(["doc", "uid"])
    around = texts.select("doc", "uid", "text", "runs").mapInArrow(
        _near, "bucket long, doc long, uid long, span long, near binary"
    )
    around = cut_lineage(around, "around")
    counts = around.groupBy("bucket").count()
    hot = cut_lineage(counts.where(F.col("count") > HOT).select("bucket"), "hot")
    n_hot = hot.count()
    some = around.join(_small(hot, n_hot), "bucket", "left_anti") if n_hot else around
    sort = some.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort, "doc long, uid long, start long, end long")
    ranges = whole.unionByName(sort)
    if n_hot:
        strings = around.join(_small(hot, n_hot), "bucket", "left_semi").mapInArrow(
            _strings, "string long, doc long, uid long, start long"
        )
        first = strings.groupBy("string").agg(F.min(F.struct("doc", "uid", "start")).alias("first"))
        later = strings.join(first, "string").where(F.struct("doc", "uid", "start") != F.col("first"))
        ranges = ranges.unionByName(later.select("doc", "uid", "start", (F.col("start") + LENGTH).alias("end")))

    before = Window.partitionBy("doc", "uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("doc", "uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    marked = ranges.withColumn("gap", gap.cast("int"))
    numbered = marked.withColumn("island", F.sum("gap").over(running))
    merged = numbered.groupBy("doc", "uid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return cut_lineage(merged.drop("island"), "ranges")


def without_repeats(documents: DataFrame, ranges: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, kept binary, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    field = documents.schema[key].dataType.simpleString()
    listed = ranges.groupBy("doc", "uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    read = documents.select(
        F.col(key).alias("key"), _first_id(key).alias("doc"), F.xxhash64(F.col(text)).alias("uid"), F.col(text).alias("text")
    )
    joined = read.join(_small(listed, ranges.count()), ["doc", "uid"], "left").select("key", "text", "cut")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.buffers(batch.column(1))
            cuts = batch.column(2)
            rows: list[tuple] = []
            for i in range(len(batch)):
                content = data[offsets[i] : offsets[i + 1]].tobytes()
                parts, at, removed, spans = [], 0, 0, 0
                if cuts[i].is_valid:
                    items = cuts[i].values
                    for start, end in zip(items.field(0).to_pylist(), items.field(1).to_pylist()):
                        parts.append(content[at:start])
                        removed += end - start
                        spans += 1
                        at = end
                kept = b"".join([*parts, content[at:]])
                rows.append((kept, len(content), removed, spans, hashlib.sha256(kept).hexdigest()))
            kept, n, removed, spans, digest = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()), pa.array(digest, pa.string()),
                ],
                names=["key", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    out = joined.mapInArrow(keep, f"key {field}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("key", key)


def remove_repeats(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    return without_repeats(documents, repeated_ranges(documents, key=key, text=text), key=key, text=text)
