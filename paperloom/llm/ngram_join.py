"""Jaccard join on shingle sets, and the groups its links make.

1. Equal sets are one node from the start: copies never meet as pairs.
2. Two sets that link share ``m`` of their first ``n - ceil(t n) + m`` shingles (the
   prefix), whatever the order, as long as it is the same for all. One shingle in
   four, by hash, is counted: in how many sets it is. The order begins with counted
   shingles of one set only, which meet nothing and fill the prefix for free; then
   come the other counted ones, rarest first, and then the rest by hash. So sets
   that share a passage or a licence line, however many, do not meet by it as long
   as a quarter of their shingles are mostly their own. ``m`` grows with the set
   (``common``), where bitmaps say less.
3. Sets of one prefix shingle meet in tiles by size: a band of sizes, and the
   larger sets that can still link to it.
4. Before any pair is made, every set of a tile is linked to one of them only
   (a star), and in its first tiles to a second one, drawn by hash. Candidates must pass the bound on the overlap from the bit counts of
   hashed bitmaps: a bitmap holds the parity of a set's hashes, so two bitmaps
   differ in at most as many bits as the sets in elements. Survivors are compared
   exactly as sorted arrays, and links become groups.
5. In tiles that still hold several groups, pairs from different groups pass the
   same bound and the same exact comparison. A pair left out is in one group
   already, so no link between groups is lost, and a large group of near copies
   costs a star, not its square.

Joins are by shingle and tile or by node, which adaptive execution splits; texts
are never shuffled: those of candidates are read again and leave as arrays.
Shingles and sets are compared by 64-bit hashes.

Defined results: a null, empty or blank text has no shingles and is a group of
its own. Repeated rows are copies and each get a row. A group's id is its least
document id; null ids do not count unless there is no other. Only id and text
are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import shingles as S
from paperloom.llm.components import components, with_ids
from paperloom.sources.durable import cut_lineage

#: One shingle in so many is counted, by the lowest bits of its hash.
COUNTED = 4
#: Bits of a set's bitmap, in longs.
BITMAP = 512
_WORDS = BITMAP // 64
_BITS = [f"bits{i}" for i in range(_WORDS)]
#: Shingles of a set for each one that a prefix must share beyond the first.
STEP = 64
#: A star's pair must share its part of those.
STAR = 4
#: Shingles of a set, first ones first, in which it also meets a set drawn by hash.
DRAWN = 24
#: Sets a task remembers to have sent.
REMEMBERED = 200_000


def _node(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each text's set."""
    total = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(S.mix(value), out=total[1:])
    n = np.diff(bounds).astype(np.uint64)
    return S.mix(total[bounds[1:]] - total[bounds[:-1]] + n * np.uint64(S.BASE)).view(np.int64)


def _bitmaps(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text the parity of its hashes in each of BITMAP places, as rows of longs."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    place = (value & np.uint64(BITMAP - 1)).astype(np.int64)
    odd = (np.bincount(owner * BITMAP + place, minlength=n * BITMAP) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, BITMAP), axis=1).view(np.int64)


def document_sets(
    documents: DataFrame, width: int, *, key: str = "doc_id", text: str = "text", hashed: bool = False
) -> DataFrame:
    """``(key, node, n, bits0..)`` of every row; ``node`` stands for the set. If asked, ``hash`` stands for the text."""
    field = T.StructField("key", documents.schema[key].dataType)
    more = ["hash"] if hashed else []
    schema = T.StructType([field] + [T.StructField(c, T.LongType()) for c in ("node", "n", *_BITS, *more)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, value, bounds in S.sets(batch.column(1), width):
                n = np.diff(bounds)
                bits = _bitmaps(value, bounds)
                columns = [batch.column(0).slice(at, len(n)), pa.array(_node(value, bounds)), pa.array(n)]
                columns += [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(_WORDS)]
                columns += [batch.column(2).slice(at, len(n))] if hashed else []
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    asked = [F.col(key).alias("key"), F.col(text).alias("text")] + [F.xxhash64(text).alias(c) for c in more]
    return documents.select(*asked).mapInArrow(read, schema)


def _prefix(size: int, percent: int) -> int:
    """Shingles of a set's prefix."""
    return min(size, size + (-percent * size // 100) + 1 + size // STEP)


def prefix_size(n: Column, percent: int) -> Column:
    """The same of a column."""
    whole = n - F.ceil(n * percent / F.lit(100)) + 1 + F.floor(n / F.lit(STEP))
    return F.least(n, whole)


def leading(documents: DataFrame, width: int, percent: int, *, text: str = "text") -> DataFrame:
    """``(shingle, node, n, counted)`` of every set that can have a link, mostly once per set.

    The shingles are all that are counted, ``counted`` of them, and if these are
    less than the prefix, the first others.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for _, value, bounds in S.sets(batch.column(0), width):
                node, n = _node(value, bounds), np.diff(bounds)
                rest = (value & np.uint64(COUNTED - 1)) != 0
                found, owners = [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    size = b - a
                    if size * (100 - percent) < percent or int(node[i]) in sent:
                        continue  # too small to differ from a set and link to it, or sent already
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(int(node[i]))
                    own, other = value[a:b][~rest[a:b]], value[a:b][rest[a:b]]
                    found += [own, other[: max(0, _prefix(size, percent) - len(own))]]
                    owners.append(np.full((len(found[-2]) + len(found[-1]), 2), (i, len(own))))
                if found:
                    owner, counted = np.concatenate(owners).T
                    columns = [pa.array(np.concatenate(found).view(np.int64)), pa.array(node[owner]), pa.array(n[owner])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(counted)], names=["shingle", "node", "n", "counted"])

    schema = "shingle long, node long, n long, counted long"
    return documents.select(F.col(text).alias("text")).mapInArrow(send, schema)


def prefixes(documents: DataFrame, width: int, percent: int, *, text: str = "text") -> DataFrame:
    """``(shingle, node, n, place)``: those shingles of every set's prefix that other sets have, too, in order."""
    sent = cut_lineage(leading(documents, width, percent, text=text), "leading")
    several = sent.groupBy("shingle").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("load")
    )
    met = sent.join(several.where("low < high").select("shingle", "load"), "shingle").distinct()
    # Counted shingles that no other set has come first: they are not here, but fill their places.
    own = F.pmod("shingle", F.lit(COUNTED)) == 0
    by_node = Window.partitionBy("node")
    met = met.withColumn("own", own).withColumn("shared", F.sum(F.col("own").cast("long")).over(by_node))
    met = met.withColumn("place", F.row_number().over(by_node.orderBy(F.desc("own"), "load", "shingle")))
    room = prefix_size(F.col("n"), percent) - (F.col("counted") - F.col("shared"))
    return met.where(~F.col("own") | (F.col("place") <= room)).select("shingle", "node", "n", "place")


def _band_starts(percent: int) -> list[int]:
    """Sizes at which bands start: within one, all sizes can link."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, starts[-1] * 100 // percent + 1))
    return starts


def _band(n: Column, starts: list[int]) -> Column:
    # The number of starts up to n: the array is a literal.
    return F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= n))


def common() -> Column:
    """Shingles that the prefixes of ``a`` and ``b`` share if they link."""
    return F.floor(F.least("a.n", "b.n") / F.lit(STEP)) + 1


def can_link(percent: int) -> Column:
    """What sizes and bitmaps of ``a`` and ``b`` leave possible: an upper bound on the overlap."""
    total = F.col("a.n") + F.col("b.n")
    differ = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in _BITS), F.lit(0))
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    return sizes & ((total - differ) * (100 + percent) >= total * (2 * percent))


def compare(
    pairs: DataFrame, nodes: DataFrame, documents: DataFrame, width: int, percent: int, *, key: str, text: str
) -> DataFrame:
    """The ``(a, b)`` of written ``pairs`` whose sets do link, by exact intersection of sorted arrays."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    where = cut_lineage(asked.join(nodes, "node").select("node", "key"), "asked")
    ids = where.select(F.col("key").alias(key))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, value, bounds in S.sets(batch.column(0), width):
                held = [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_node(value, bounds)), pa.array(held, type=pa.binary())], names=["node", "held"]
                )

    texts = with_ids(documents.select(F.col(key), F.col(text).alias("text")), ids, key, "left_semi").select("text")
    arrays = texts.mapInArrow(read, "node long, held binary")
    # An id with several texts brings nodes nobody asked for, and a node can come twice.
    arrays = arrays.join(where.select("node"), "node", "left_semi").dropDuplicates(["node"])
    arrays = cut_lineage(arrays, "arrays")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for one, other in zip(batch.column("x"), batch.column("y")):
                x = np.frombuffer(one.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(other.as_buffer(), dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(links)), batch.column("b").filter(pa.array(links))], names=["a", "b"]
            )

    second = arrays.select(F.col("node").alias("b"), F.col("held").alias("y"))
    first = arrays.select(F.col("node").alias("a"), F.col("held").alias("x"))
    both = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "x", "y")
    return both.mapInArrow(meet, "a long, b long")


def groups(
    documents: DataFrame, *, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row of ``documents``.

    Sets link if ``100 * intersection >= percent * union``.
    """
    rows, ids = _linked(documents, width, percent, key=key, text=text)
    names = ids.groupBy("component").agg(F.min("key").alias("component_id"))
    by_node = ids.join(names, "component").select("node", "component_id")
    out = rows.select("key", "node", "n").join(by_node, "node", "left")
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
    )


def _linked(
    documents: DataFrame, width: int, percent: int, *, key: str, text: str, hashed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The written sets of all rows, and ``(node, key, component)`` of every set that has shingles."""
    if not 50 <= percent <= 99:
        raise ValueError("percent must be from 50 to 99")
    rows = cut_lineage(document_sets(documents, width, key=key, text=text, hashed=hashed), "sets")
    nodes = rows.where("n > 0").groupBy("node").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in _BITS]
    )
    nodes = cut_lineage(nodes, "nodes")
    starts = _band_starts(percent)
    met = prefixes(documents, width, percent, text=text)
    met = cut_lineage(met.withColumn("tile", _band(F.col("n"), starts)), "met")

    facts = nodes.select("node", "n", *_BITS)
    centers = met.groupBy("shingle", "tile").agg(F.min("node").alias("a"))
    stars = met.join(centers, ["shingle", "tile"]).where("a <> node").groupBy("a", F.col("node").alias("b"))
    stars = stars.agg(F.count(F.lit(1)).alias("shared"))
    # Near copies at the threshold may all miss the one least node: some drawn ones connect them.
    early = met.where(F.col("place") <= DRAWN)
    drawn = early.groupBy("shingle", "tile").agg(F.min_by("node", F.xxhash64("node", "shingle")).alias("a"))
    drawn = early.join(drawn, ["shingle", "tile"]).where("a <> node")
    drawn = drawn.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    stars = stars.unionByName(drawn.withColumn("shared", F.lit(1 << 40)))
    a = facts.select(F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("n", *_BITS)])
    stars = stars.join(facts.withColumnRenamed("node", "b"), "b").join(a, "a")
    one = F.struct(*[F.col(f"a_{c}").alias(c) for c in ("n", *_BITS)]).alias("a")
    two = F.struct("n", *_BITS).alias("b")
    likely = stars.select(F.col("a").alias("one"), F.col("b").alias("two"), "shared", one, two)
    likely = likely.where(can_link(percent) & (F.col("shared") * STAR >= common()))
    pairs = cut_lineage(likely.select(F.col("one").alias("a"), F.col("two").alias("b")).distinct(), "pairs")
    linked = cut_lineage(components(compare(pairs, nodes, documents, width, percent, key=key, text=text)), "linked")

    # What is left: tiles with sets of several groups.
    named = met.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left = named.join(mixed.where("low < high").select("shingle"), "shingle").select("shingle", "node", "component", "tile")
    left = cut_lineage(left.join(facts, "node"), "left")
    # A smaller set stays in its band; a larger one visits every band it can link to.
    reach = F.sequence(_band(F.ceil(F.col("n") * percent / F.lit(100)), starts), F.col("tile"))
    visiting = left.withColumn("tile", F.explode(reach))
    smaller, larger = left.alias("a"), visiting.alias("b")
    meeting = (
        (F.col("a.shingle") == F.col("b.shingle"))
        & (F.col("a.tile") == F.col("b.tile"))
        & (F.col("a.component") != F.col("b.component"))
        & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node"))))
        & can_link(percent)
    )
    rest = smaller.join(larger, meeting).select(
        F.col("a.node").alias("one"), F.col("b.node").alias("two"), common().alias("needed")
    )
    rest = rest.groupBy(F.col("one").alias("a"), F.col("two").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.first("needed").alias("needed")
    )
    rest = cut_lineage(rest.where("shared >= needed").select("a", "b"), "pairs")
    more = compare(rest, nodes, documents, width, percent, key=key, text=text)
    known = linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
    whole = components(known.union(more))

    least = nodes.select("node", "key").join(whole, "node", "left")
    least = least.withColumn("component", F.coalesce("component", "node"))
    return rows, cut_lineage(least, "components")


def keep_one(
    documents: DataFrame, *, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents with one row of each group: that of least id, null last, and among those of least text hash.

    A row is known by its id and a hash of its text, as ids can be null or repeated.
    """
    rows, ids = _linked(documents, width, percent, key=key, text=text, hashed=True)
    rows = rows.where("n > 0").select("key", "hash", "node")
    place = F.struct(F.col("key").isNull().alias("last"), "key", "hash")
    best = rows.groupBy("node").agg(F.min(place).alias("best"))
    best = cut_lineage(ids.select("node", "component").join(best, "node"), "best")
    first = best.groupBy("component").agg(F.min("best").alias("first"))
    by_node = best.join(first, "component").select("node", "first")
    stays = (F.col("first.hash") == F.col("hash")) & F.col("first.key").eqNullSafe(F.col("key"))
    placed = rows.join(by_node, "node").groupBy(F.col("key").alias(key), "hash").agg(
        F.first(stays).alias("stays"), F.count(F.lit(1)).alias("count")
    )
    placed = cut_lineage(placed.where("not stays or count > 1"), "groups")
    kept = with_ids(documents, placed.where("not stays").select(key, "hash"), key, "left_anti", text=text)
    again = placed.where("stays").select(key, "hash")
    if again.isEmpty():
        return kept
    twice = with_ids(kept, again, key, "left_semi", text=text)
    return with_ids(kept, again, key, "left_anti", text=text).unionByName(twice.dropDuplicates([key, text]))


JOIN_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (
  select distinct doc_id, array_to_string(ws[i : i + 2], ' ') as s
  from words, unnest(range(1, greatest(len(ws) - 1, 2))) r(i) where len(ws) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as n
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select x, y from shared h join sizes a on a.doc_id = h.x join sizes b on b.doc_id = h.y
  where 100 * h.n >= 90 * (a.n + b.n - h.n)),
edges as (select x, y from links union all select y, x from links),
reach as (
  select doc_id as x, doc_id as y from sizes
  union
  select r.x, e.y from reach r join edges e on r.y = e.x),
least as (select x, min(y) as c from reach group by x)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.c, d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join least l on l.x = d.doc_id
"""
