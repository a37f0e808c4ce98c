"""Periodic runs of words, found by a sparse dynamic program over diagonals.

A run is a stretch of words with least period q, at least ``max(least, 2 q)`` words
long, that no neighbouring word extends with that period. On the diagonal of lag q
(words equal to the word q before) it is a row of matches, as long as the stretch
less q. Words are read in order: a word's earlier occurrences open or lengthen the
diagonals of their lags, and a diagonal whose next word differs is closed and, if it
is long enough, emitted at once.

Sparse means that occurrences which cannot belong to a run open nothing:

- A run of lag q holds ``m`` matches in a row for every ``m <= q``, and six for the
  lags below twelve. So lags from m to 2m - 1 are opened by stretches of m words
  that occurred before (m = 6 for the lags up to 11, then 12, 24, 48, ...), and only
  places where a shorter stretch has occurred before are looked at for a longer one.
- A place opens nothing if its stretch also occurred at most m / 4 words before: it
  repeats with a smaller period. A run of lag q has a place where this is not so, as
  otherwise its period would be smaller. So few lags are opened at a place, and texts
  that repeat one line or one word a thousand times cost n log n steps, not n^2.
- A lag is not opened if one that divides it is open and has lasted for the lag and
  its own period: both end at the same word, and the smaller one is the period.

Stretches are found by 64-bit hashes, which only propose: matches are counted on the
words. The text never leaves its row, so there is nothing to shuffle.

Defined results: a null, empty or blank text has no words and no runs, and the empty
string is kept. Repeated rows each get their own row, null ids too. A text is read
whole, whatever its length; memory is in proportion to the longest text, or to about
a million bytes of shorter ones together. Only id and text are read, so other
columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.shingles import mix

LEAST = 12
#: Bytes of texts whose words are looked at together.
TOGETHER = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _joined(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring stretches."""
    return mix(before * _ODD + after + np.uint64(1))


def _again(hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes are there twice or more."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(hashes), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _opened(hashes: np.ndarray, ends: np.ndarray, m: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """``(end, lag)`` of stretches of ``m`` words, by hash and last word, that open a lag from ``low`` to ``high``."""
    order = np.lexsort((ends, hashes))
    ends, hashes = ends[order], hashes[order]
    group = np.cumsum(np.concatenate(([0], hashes[1:] != hashes[:-1])))
    room = int(ends.max()) + high + 2
    key = group * room + ends + high
    first = np.searchsorted(key, key - high)
    after = np.searchsorted(key, key - low, side="right")
    near = np.zeros(len(key), dtype=bool)
    if low >= m:  # a class of lags above the least
        near[1:] = (group[1:] == group[:-1]) & (4 * (ends[1:] - ends[:-1]) <= m)
    count = np.where(near, 0, after - first)
    owner = np.repeat(np.arange(len(key)), count)
    other = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    return ends[owner], ends[owner] - ends[other]


def _proposals(ids: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """``(ends, lags, m)`` of each class of lags: where stretches of ``m`` words open which lags."""
    n, short = len(ids), least // 2
    stretch = mix(ids.astype(np.uint64) * _ODD + np.uint64(7))
    hashes = stretch
    for k in range(1, short):
        hashes = _joined(hashes[:-1], stretch[k:])
    ends = np.arange(short - 1, n)
    alive = _again(hashes)
    out, m, low = [], short, 1
    by_end = np.zeros(n, dtype=np.uint64)
    while alive.any():
        ends, hashes = ends[alive], hashes[alive]
        out.append((*_opened(hashes, ends, m, low, max(least, 2 * m) - 1 if m > short else least - 1), m))
        # The next stretch is twice as long; both its halves must have occurred before.
        by_end[:] = 0
        by_end[ends] = hashes
        known = np.zeros(n, dtype=bool)
        known[ends] = True
        longer = ends[(ends >= m) & known[np.maximum(ends - m, 0)]]
        hashes = _joined(by_end[longer - m], by_end[longer])
        ends, m = longer, 2 * m
        low = m
        alive = _again(hashes)
    return out


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a sequence, by start, then period. ``least`` is even, four or more."""
    if len(words) < least:
        return []
    number: dict = {}
    ids = [number.setdefault(word, len(number)) for word in words]
    events: dict[int, list[tuple[int, int]]] = {}
    for ends, lags, m in _proposals(np.array(ids), least):
        for end, lag in zip(ends.tolist(), lags.tolist()):
            events.setdefault(end, []).append((lag, m))
    return _sweep(ids, events, least)


def _sweep(ids: list[int], events: dict[int, list[tuple[int, int]]], least: int) -> list[tuple[int, int, int]]:
    """The runs, word by word: ``events`` holds ``(lag, m)`` to be opened at a word."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    active: dict[int, int] = {}  # lag: first matching word of its diagonal

    def close(lag: int, end: int) -> None:
        start = active.pop(lag) - lag
        if end - start >= max(least, 2 * lag):
            stretch = (start, end - start)
            found[stretch] = min(lag, found.get(stretch, lag))

    at = 0
    for event in [*sorted(events), n]:
        # Words up to the next one that opens something only lengthen or close what is open.
        while active and at < event:
            word = ids[at]
            for lag in [lag for lag in active if ids[at - lag] != word]:
                close(lag, at)
            at += 1
        at = event
        if at == n:
            break
        word = ids[at]
        for lag in [lag for lag in active if ids[at - lag] != word]:
            close(lag, at)
        for lag, m in sorted(events[at]):
            if lag in active or any(lag % d == 0 and at + 1 - first >= lag for d, first in active.items()):
                continue
            first = at
            while first > lag and ids[first - 1] == ids[first - 1 - lag]:
                first -= 1
            if ids[at] == ids[at - lag] and at + 1 - first >= m:
                active[lag] = first
        at += 1
    for lag in list(active):
        close(lag, n)
    return sorted((start, length, lag) for (start, length), lag in found.items())


def keep_once(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [word for word, covered in zip(words, np.cumsum(change).tolist()) if not covered]


def _suspects(texts: list[list[bytes]], least: int) -> list[bool]:
    """Which texts repeat a stretch of ``least // 2`` words; only those can hold a run."""
    short = least // 2
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for words in texts for word in words], dtype=np.uint64)
    if len(ids) < least:
        return [False] * len(texts)
    owner = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    stretch = mix(ids * _ODD + owner.astype(np.uint64))
    hashes = stretch
    for k in range(1, short):
        hashes = _joined(hashes[:-1], stretch[k:])
    same = _again(hashes) & (owner[: len(hashes)] == owner[short - 1 :])
    return np.bincount(owner[: len(hashes)][same], minlength=len(texts)).astype(bool).tolist()


def _groups(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of the texts, about TOGETHER bytes of text at a time, with the number of the first text."""
    first, texts, size = 0, [], 0
    for place, value in enumerate(column):
        data = (value.as_py() or "").encode("utf-8", "surrogatepass")
        if texts and size + len(data) > TOGETHER:
            yield first, texts
            first, texts, size = place, [], 0
        texts.append(data.split())
        size += len(data)
    if texts:
        yield first, texts


def find_runs(documents: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``(key, n_words, runs, kept)``: each text's runs, and its words without their repetitions, a space apart.

    ``runs`` is an array of ``(start, length, period)``, by start, then period.
    """
    if least < 4 or least % 2:
        raise ValueError("least must be even, and 4 or more")
    run = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    added = [("n_words", T.LongType()), ("runs", T.ArrayType(run)), ("kept", T.StringType())]
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), *[T.StructField(*field) for field in added]])
    arrow_run = pa.list_(pa.struct([(name, pa.int64()) for name in run.names]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch.column(1)):
                runs, kept = [], []
                for words, suspect in zip(texts, _suspects(texts, least)):
                    here = runs_of(words, least) if suspect else []
                    runs.append([dict(zip(run.names, one)) for one in here])
                    kept.append(b" ".join(keep_once(words, here) if here else words).decode("utf-8", "surrogatepass"))
                columns = [batch.column(0).slice(first, len(texts)), pa.array([len(words) for words in texts], type=pa.int64())]
                columns += [pa.array(runs, type=arrow_run), pa.array(kept, type=pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return documents.select(key, text).mapInArrow(read, schema)


def with_tails(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)`` where about one text in ten repeats some of its own words to its end, by a checksum of its id.

    Null ids keep their text.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    hashed = documents.select(F.col(key), F.col(text), F.crc32(F.col(key).cast("string")).alias("_h"))
    chosen = F.coalesce(F.col("_h") % 10 == 0, F.lit(False))
    listed = hashed.withColumn("_words", F.when(chosen, words)).withColumn("_n", F.size("_words").cast("bigint"))
    start = F.expr("(_h div 10) % _n")
    placed = listed.withColumn("_a", F.when(F.col("_n") > 0, start))
    period = F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)")
    placed = placed.withColumn("_p", period)
    tail = F.expr(
        "array_join(transform(sequence(0L, _n - 1), i -> "
        "element_at(_words, cast(1 + if(i < _a, i, _a + (i - _a) % _p) as int))), ' ')"
    )
    return placed.select(key, F.when(F.col("_a").isNotNull(), tail).otherwise(F.col(text)).alias(text))


def _longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the least start, then period."""
    ranked = F.transform(
        runs, lambda r: F.struct(-r["length"], r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))
    )
    return F.array_min(ranked)


def runs_query(documents: DataFrame) -> DataFrame:
    """Runs of all documents, some of them with repeating tails: counts, the longest run, and digests."""
    found = find_runs(with_tails(documents))
    longest = F.col("longest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", _longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        longest["start"].alias("start"),
        longest["length"].alias("length"),
        longest["period"].alias("period"),
        F.expr("(1000 * longest.length) div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("kept"), 256).alias("collapsed_sha256"),
    )


RUNS_SQL = r"""
with hashed as (
  select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws,
    xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
      string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295) as h
  from documents),
drawn as (
  select r, doc_id, ws, len(ws) as n, h // 10 as g,
    case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a from hashed),
tailed as (
  select r, doc_id, n, case when a is null then ws else list_transform(range(0, n), lambda i:
    ws[1 + (case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end)]) end as ws from drawn),
grams as (
  select r, i, hash(ws[i + 1 : i + 6]) as s, ws[i + 1 : i + 6] as gram
  from tailed, unnest(range(0, n - 5)) u(i) where n >= 12),
matches as (
  select b.r, b.i, b.i - a.i as q from grams a join grams b on a.r = b.r and a.s = b.s and a.i < b.i and a.gram = b.gram),
diagonals as (
  select r, q, min(i) - q as start, count(*) + 5 + q as length
  from (select *, i - row_number() over (partition by r, q order by i) as island from matches) group by r, q, island),
runs as (
  select r, start, length, min(q) as period from diagonals
  where length >= 12 and length >= 2 * q group by r, start, length),
listed as (
  select r, count(*) as n_runs, first({'s': start, 'l': length, 'p': period} order by length desc, start, period) as longest,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
  from runs group by r),
dropped as (
  select distinct r, i from runs, unnest(range(start + period, start + length)) u(i)),
kept as (
  select t.r, string_agg(ws[i + 1], ' ' order by i) as text
  from tailed t, unnest(range(0, n)) u(i) anti join dropped d on d.r = t.r and d.i = u.i group by t.r)
select t.doc_id, coalesce(l.n_runs, 0) as n_runs, longest.s as start, longest.l as length, longest.p as period,
  1000 * longest.l // longest.p as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from tailed t left join listed l on l.r = t.r left join kept k on k.r = t.r
"""
