"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are turned by a learned rotation (principal axes, then alternating
between signs and the best rotation towards them) and keep one bit per axis. The
code is cut into substrings. If two codes differ in at most ``radius`` bits, one
substring differs in few: with ``radius = m * a + r``, one of the first ``r + 1``
of ``m`` in at most ``a`` bits, or one of the others in at most ``a - 1``. So
every substring is indexed, a query probes the values near its own in each index,
and no code within the radius is missed. Codes found are checked in full, counted
in the first index that finds them, and ranked by exact inner products in double
precision. The first radius is measured on PROBES queries against all rows: the least
that holds WITHIN of their exact neighbours, and enough codes for as many of them. So
it shrinks where more rows, or rows nearer to each other, bring neighbours closer.
Queries with fewer than ``DEPTH * k`` different codes, or ``k`` rows, within the radius ask
again with larger radii: few vectors are far apart. Rows of one code count once, by the
row that stands for it, so that a group of equal vectors does not end a search.

Larger norms draw inner products: vectors get one more axis that makes their norms
equal, before the codes are learned; queries have 0 there.

An index is dealt by substring, the leading bits of its value, and a hash where a
value is frequent, into tiles of about TILE vectors; queries go, in blocks, to the
tiles whose leading bits are near enough, and each tile sends back at most ``k``
rows a query. A tile is copied once for each block of the queries that go to it, and
left out if none does. The rotation is fitted on at most SAMPLE vectors of least hash.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part. Ties go to the smaller id.
Rows of one id and vector count once; a row is never its own id's neighbour. An
empty table gives no rows. Only id and vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.sampling import thinned
from paperloom.sources.durable import cut_lineage

#: Vectors the rotation is fitted on.
SAMPLE = 4096
#: Bits of a code and of a substring, at most.
BITS = 64
SUBSTRING = 16
#: Queries whose exact neighbours the first radius is measured on, and the share of these it holds.
PROBES = 256
WITHIN = 0.95
#: Radii as shares of the bits, asked next by queries with too few; those below the first are left out.
RADII = (0.4375, 0.5, 0.625, 1.0)
#: Bits by which the first radius grows up to the least of these.
STEP = 4
#: Codes within the radius that a query must have ranked, for each neighbour wanted.
DEPTH = 50
#: Vectors, and queries, of one tile.
TILE = 16_384
QUERIES = 4096


@dataclass(frozen=True)
class Codes:
    """Rotated axes: a vector's bits are the signs of ``(v / scale, rest) @ axes - shift``."""

    dimension: int
    scale: float
    axes: np.ndarray
    shift: np.ndarray

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def of(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        wide = _level(vectors, self.scale, query)
        signs = wide @ self.axes > self.shift
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _level(vectors: np.ndarray, scale: float, query: bool) -> np.ndarray:
    """Vectors with an axis that makes all norms 1; queries are scaled, with 0 there."""
    if query:
        return np.c_[vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros(len(vectors))]
    small = vectors / scale
    return np.c_[small, np.sqrt(np.maximum(0.0, 1 - (small**2).sum(axis=1)))]


def learn(sample: np.ndarray, scale: float, rounds: int = 30, seed: int = 7) -> Codes:
    """Principal axes and a rotation of them that brings the sample near its signs."""
    wide = _level(sample, scale, query=False)
    center = wide.mean(axis=0)
    moved = wide - center
    _, axes = np.linalg.eigh(moved.T @ moved)
    axes = axes[:, ::-1][:, : min(BITS, sample.shape[1])]
    turned = moved @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(turned @ rotation > 0, 1.0, -1.0).T @ turned)
        rotation = (left @ right).T
    final = axes @ rotation
    return Codes(sample.shape[1], scale, final, center @ final)


def substrings(bits: int) -> list[tuple[int, int]]:
    """``(first bit, number of bits)`` of each substring."""
    parts = max(1, -(-bits // SUBSTRING))
    edges = [round(i * bits / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def radii(radius: int, parts: int) -> list[int]:
    """Least radius per substring such that no code within ``radius`` is missed; -1 needs no probe."""
    whole, rest = divmod(radius, parts)
    return [whole if i <= rest else whole - 1 for i in range(parts)]


def valid(vector: Column, dimension: int) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimension) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _array(column: pd.Series, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(-1, dimension)


class _Tile:
    """Rows of an index whose values of a substring have the same leading bits.

    They lie in the order of the other, low bits: ``values`` has the distinct ones,
    ``bounds`` where the rows of each begin, and ``place`` the number of each or -1.
    """

    def __init__(self, codes: np.ndarray, first: int, low: int) -> None:
        value = self._low(codes, first, low)
        self.first, self.low = first, low
        self.order = np.argsort(value, kind="stable")
        self.codes = codes[self.order]
        self.values, begins = np.unique(value[self.order], return_index=True)
        self.bounds = np.r_[begins, len(codes)]
        self.place = np.full(1 << low, -1, dtype=np.int32)
        self.place[self.values] = np.arange(len(self.values), dtype=np.int32)
        # All low bits by how many are set, and how many there are up to each number.
        every = np.arange(1 << low, dtype=np.uint16)
        ones = np.bitwise_count(every)
        self.masks = every[np.argsort(ones, kind="stable")]
        self.upto = np.cumsum(np.bincount(ones, minlength=low + 1))

    @staticmethod
    def _low(codes: np.ndarray, first: int, low: int) -> np.ndarray:
        return (codes >> np.uint64(first) & np.uint64((1 << low) - 1)).astype(np.uint16)

    def within(self, own: np.uint16, near: int) -> np.ndarray:
        """Places in the order of the rows whose low bits differ from ``own`` in at most ``near``."""
        probes = int(self.upto[min(near, self.low)])
        if probes < len(self.values):
            hit = self.place[self.masks[:probes] ^ own]
            hit = hit[hit >= 0]
        else:
            hit = np.flatnonzero(np.bitwise_count(self.values ^ own) <= near)
        begins = self.bounds[hit]
        lengths = self.bounds[hit + 1] - begins
        ends = np.cumsum(lengths)
        return np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)

    def probe(
        self, queries: np.ndarray, part: int, slot: int, cuts: Sequence[tuple[int, int]], near: Sequence[int], radius: int
    ) -> Iterator[np.ndarray]:
        """For each query, places of the rows within ``radius`` that substring ``part`` is the first to find."""
        first, width = cuts[part]
        lead = queries >> np.uint64(first + self.low) & np.uint64((1 << width - self.low) - 1)
        left = near[part] - np.bitwise_count(lead ^ np.uint64(slot)).astype(np.int64)
        for query, own, rest in zip(queries, self._low(queries, self.first, self.low), left):
            found = self.within(own, int(rest))
            differ = self.codes[found] ^ query
            inside = np.flatnonzero(np.bitwise_count(differ) <= radius)
            found, differ = found[inside], differ[inside]
            for i in range(part):
                low, length = cuts[i]
                missed = np.bitwise_count(differ >> np.uint64(low) & np.uint64((1 << length) - 1)) > near[i]
                found, differ = found[missed], differ[missed]
            yield found


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= least)
    else:
        rows = np.arange(len(scores))
    return rows[np.lexsort((ids[rows], -scores[rows]))][:k]


def _nearest(
    vectors: np.ndarray, ids: np.ndarray, found: np.ndarray, query: np.ndarray, k: int, largest: float
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of the ``found`` rows, and their inner products, each summed alike wherever it is met."""
    if len(found) > k:
        # A product with the matrix may round otherwise; what it leaves out is out of reach of that.
        rough = vectors[found] @ query
        slack = 8 * len(query) * (np.finfo(np.float64).eps * largest * np.linalg.norm(query) + np.finfo(np.float64).tiny)
        found = found[~(rough < np.partition(rough, len(rough) - k)[len(rough) - k] - slack)]
    scores = (vectors[found] * query).sum(axis=1)
    best = _best(scores, ids[found], k)
    return found[best], scores[best]


def measured(base: DataFrame, queries: DataFrame, model: Codes, k: int, wanted: int) -> int:
    """First radius, measured on PROBES queries of least hash against all rows.

    The least that holds WITHIN of their exact ``k`` neighbours, and with which as
    large a share of them has ``wanted`` different codes.
    """
    chosen = thinned(queries, 2 * PROBES, "vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(PROBES)
    rows = chosen.select("vec_id", "vector", "code").collect()
    names = np.array([row["vec_id"] for row in rows], dtype=np.int64)
    own = np.frombuffer(b"".join(row["vector"] for row in rows), dtype=np.float64).reshape(-1, model.dimension)
    asked = np.array([row["code"] for row in rows], dtype=np.int64).view(np.uint64)
    wide = model.bits + 1

    def compare(frames):
        scores, differ = np.empty((len(names), 0)), np.empty((len(names), 0), dtype=np.int64)
        codes = np.zeros((len(names), wide), dtype=np.int64)
        for frame in frames:
            if frame.empty:
                continue
            ids = frame["vec_id"].to_numpy()
            apart = np.bitwise_count(asked[:, None] ^ frame["code"].to_numpy().view(np.uint64))
            for row, held in zip(codes, apart[:, frame["counts"].to_numpy()]):
                row += np.bincount(held, minlength=wide)
            new = own @ _array(frame["vector"], model.dimension).T
            new[names[:, None] == ids] = -np.inf
            best = np.argpartition(-new, min(k, len(ids)) - 1, axis=1)[:, :k]
            scores = np.c_[scores, np.take_along_axis(new, best, axis=1)]
            differ = np.c_[differ, np.take_along_axis(apart, best, axis=1)]
            best = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]
            scores, differ = np.take_along_axis(scores, best, axis=1), np.take_along_axis(differ, best, axis=1)
        query, at = np.nonzero(scores > -np.inf)
        yield pd.DataFrame({"query": query, "differ": differ[query, at], "score": scores[query, at], "codes": 0})
        query, at = np.nonzero(codes)
        yield pd.DataFrame({"query": query, "differ": at, "score": np.nan, "codes": codes[query, at]})

    compared = base.select("vec_id", "vector", "code", "counts").mapInPandas(compare, "query long, differ long, score double, codes long")
    compared = cut_lineage(compared, "compared")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "differ")
    near = compared.where("codes = 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    held = np.zeros(wide, dtype=np.int64)
    for row in near.groupBy("differ").count().collect():
        held[row["differ"]] = row["count"]
    codes = np.zeros((len(names), wide), dtype=np.int64)
    for row in compared.where("codes > 0").groupBy("query", "differ").agg(F.sum("codes").alias("codes")).collect():
        codes[row["query"], row["differ"]] = row["codes"]
    enough = (np.cumsum(codes, axis=1) >= wanted).mean(axis=0) if len(names) else np.ones(wide)
    fine = np.flatnonzero((np.cumsum(held) >= WITHIN * held.sum()) & (enough >= WITHIN))
    return int(fine[0]) if len(fine) else model.bits


def _round(base: DataFrame, queries: DataFrame, model: Codes, k: int, radius: int) -> DataFrame:
    """``(query_id, vec_id, score, hits)``: at most ``k`` a tile, of all within ``radius``.

    A tile's first row of a query has the number of different codes it ranked.
    """
    cuts = substrings(model.bits)
    near = radii(radius, len(cuts))
    lead = min(cuts[0][1], max(0, math.ceil(math.log2(max(1, base.count() / TILE)))))
    low = [max(0, width - lead) for _, width in cuts]

    def slot(part: int, code: Column) -> Column:
        first, width = cuts[part]
        value = F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        return F.shiftright(value, low[part]).cast("int")

    parts = [p for p in range(len(cuts)) if near[p] >= 0]
    places = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), slot(p, F.col("code")).alias("slot")) for p in parts]))
    index = base.select("vec_id", "vector", "code", "counts", places.alias("at"))
    index = index.select("vec_id", "vector", "code", "counts", "at.*")
    sizes = cut_lineage(index.groupBy("part", "slot").count(), "slots")
    salted = sizes.select("part", "slot", F.ceil(F.col("count") / F.lit(2 * TILE)).cast("int").alias("salts"))

    # A query goes to its own leading bits, and to those with as many flipped as are near.
    flips = [F.struct(F.lit(p).alias("part"), F.lit(near[p]).alias("near"), F.lit(1 << cuts[p][1] - low[p]).alias("ends")) for p in parts]
    flips = base.sparkSession.range(1 << lead).select(F.col("id").cast("int").alias("flip"), F.explode(F.array(*flips)).alias("at"))
    flips = flips.where((F.bit_count("flip") <= F.col("at.near")) & (F.col("flip") < F.col("at.ends"))).select("at.part", "flip")
    reach = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), slot(p, F.col("code")).alias("own")) for p in parts]))
    going = queries.select("vec_id", "vector", "code", reach.alias("at")).select("vec_id", "vector", "code", "at.*")
    going = going.join(F.broadcast(flips), "part").withColumn("slot", F.col("own").bitwiseXOR(F.col("flip"))).drop("own", "flip")
    asked = going.groupBy("part", "slot").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("blocks"))
    salted = cut_lineage(salted.join(asked, ["part", "slot"]), "tiles")

    spread = F.pmod(F.xxhash64("vec_id", "part"), F.col("salts")).cast("int")
    dealt = index.join(salted, ["part", "slot"]).withColumn("salt", spread).drop("salts")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    going = going.join(salted, ["part", "slot"]).withColumn("block", block).drop("blocks")
    going = going.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # Names of its own: both sides come from one table.
    going = going.select(*[F.col(c).alias(f"q_{c}") for c in ("vec_id", "vector", "code", "part", "slot", "salt", "block")])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, rows, scores, hits = [], [], [], []
        if len(left) and len(right):
            part, slot = int(left["part"].iloc[0]), int(left["slot"].iloc[0])
            tile = _Tile(left["code"].to_numpy().view(np.uint64), cuts[part][0], low[part])
            ids, counts = left["vec_id"].to_numpy()[tile.order], left["counts"].to_numpy()[tile.order]
            vectors = _array(left["vector"], model.dimension)[tile.order]
            largest = float(np.linalg.norm(vectors, axis=1).max())
            asking = right["q_vec_id"].to_numpy()
            own = _array(right["q_vector"], model.dimension)
            probed = tile.probe(right["q_code"].to_numpy().view(np.uint64), part, slot, cuts, near, radius)
            for name, vector, found in zip(asking, own, probed):
                found = found[ids[found] != name]
                if len(found):
                    best, score = _nearest(vectors, ids, found, vector, k, largest)
                    names.append(np.full(len(best), name))
                    rows.append(ids[best])
                    scores.append(score)
                    hits.append(np.r_[counts[found].sum(), np.zeros(len(best) - 1, dtype=np.int64)])
        columns = {"query_id": names, "vec_id": rows, "score": scores, "hits": hits}
        kinds = {"score": np.float64}
        return pd.DataFrame({c: np.concatenate([np.empty(0, kinds.get(c, np.int64)), *x]) for c, x in columns.items()})

    tile = ["part", "slot", "salt", "block"]
    return dealt.groupBy(*tile).cogroup(going.groupBy(*[f"q_{c}" for c in tile])).applyInPandas(
        search, "query_id long, vec_id long, score double, hits long"
    )


def neighbours(
    vectors: DataFrame, queries: Column, *, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    shares: Sequence[float] = RADII,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product found for each query.

    ``queries`` says which rows ask; all other rows answer. ``shares`` are the radii,
    of the bits, that follow the measured one.
    """
    lengths = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count()
    most = lengths.where("d > 0").orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dimension = most["d"]
    as_double = F.transform(F.col(vector), lambda x: x.cast("double"))
    read = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), as_double.alias("vector"), queries.alias("asks"))
    read = read.where(valid(F.col("vector"), dimension))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    largest = read.agg(F.max(norm).alias("norm")).first()["norm"]
    if largest is None:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = thinned(read, 2 * SAMPLE, "vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).select("vector").collect()
    model = learn(np.array([row["vector"] for row in rows], dtype=np.float64), float(largest))

    def encode(frames):
        for frame in frames:
            held = np.array(frame["vector"].tolist(), dtype=np.float64).reshape(-1, dimension)
            yield pd.DataFrame(
                {
                    "vec_id": frame["vec_id"],
                    "vector": [v.tobytes() for v in held],
                    "asks": frame["asks"],
                    "code": model.of(held, query=False).view(np.int64),
                    "query_code": model.of(held, query=True).view(np.int64),
                }
            )

    coded = read.mapInPandas(encode, "vec_id long, vector binary, asks boolean, code long, query_code long")
    coded = cut_lineage(coded.dropDuplicates(["vec_id", "vector"]), "codes")
    # One row stands for each code; a join by all three keeps a frequent code from one task.
    this = F.struct("vec_id", F.xxhash64("vector").alias("hash"))
    first = coded.groupBy("code").agg(F.min(this).alias("first")).select("code", "first.*", F.lit(True).alias("counts"))
    base = coded.select("vec_id", "vector", "code", F.xxhash64("vector").alias("hash"))
    base = base.join(first, ["code", "vec_id", "hash"], "left")
    base = base.select("vec_id", "vector", "code", F.coalesce("counts", F.lit(False)).alias("counts"))
    base = cut_lineage(base, "base")
    asking = coded.where("asks").select("vec_id", "vector", F.col("query_code").alias("code"))
    # Codes a query can surely count: its own row may stand for one, and so may others of its id.
    others = coded.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    others = base.where("counts").count() - others
    wanted = min(DEPTH * k, others)
    start = measured(base, asking, model, k, wanted)
    last = [round(share * model.bits) for share in shares]
    # Queries with few codes nearby go out step by step: the more rows, the nearer are enough of them.
    wider = [start, *range(start + STEP, min(last, default=0), STEP), *[radius for radius in last if radius > start]]
    ranked = None
    for number, radius in enumerate(wider):
        found = _round(base, asking, model, k, radius)
        found = cut_lineage(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("hits").alias("hits")), "hits")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = cut_lineage(top.select("query_id", "rank", "vec_id", "score"), "found")
        if number + 1 == len(wider):
            return top if ranked is None else ranked.unionByName(top)
        ranked_codes = found.groupBy("query_id").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("rows"))
        full = ranked_codes.where((F.col("hits") >= wanted) & (F.col("rows") >= k)).select("query_id")
        done = top.join(full, "query_id", "left_semi")
        ranked = done if ranked is None else ranked.unionByName(done)
        asking = cut_lineage(asking.join(full, asking["vec_id"] == full["query_id"], "left_anti"), "asking")
        if asking.isEmpty():
            return ranked
    return ranked


def neighbours_query(embeddings: DataFrame) -> DataFrame:
    return neighbours(embeddings, F.col("vec_id") % 20 == 0)
