"""Operators that bring rows together, against loops on small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import components, hamming, mixing, ngram_join, packing, repeats, revisits

# --- near copies -----------------------------------------------------------------


def brute_groups(rows, width, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), name), name)
    return sorted((rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows)))


def near_copies(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    bases = [[word() for _ in range(rng.choice([4, 12, 40, 150, 400]))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a  B"), (5, "one")]
    for i in range(6, n):
        words = list(rng.choice(bases)) if rng.random() < 0.8 else [word() for _ in range(30)]
        for _ in range(rng.choice([0, 0, 1, 2, 4, 12])):
            words[rng.randrange(len(words))] = word()
        rows.append((i, (" " if i % 2 else "\n").join(words)))
    return rows


@pytest.mark.parametrize("width, percent, seed", [(3, 90, 1), (5, 80, 2)])
def test_groups_against_all_pairs(spark, width, percent, seed):
    rows = near_copies(seed, 130)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ngram_join.groups(docs, width=width, percent=percent).collect()
    assert sorted(map(tuple, found)) == brute_groups(rows, width, percent)


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "n"), (3, text, "n"), (3, text, "n"), (4, text + " more", "n"), (7, None, "n"), (8, "", "n"), (None, "else", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "None"]
    assert ngram_join.groups(docs.limit(0)).count() == 0


def test_rows_stay_or_go_by_id_and_text(spark):
    def text(name, more=""):
        return " ".join(f"{name}{i}" for i in range(40)) + more

    rows = [
        (None, text("a", " x")), (3, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (3, text("d")),
        (4, text("a", " y")), (4, text("e")), (4, None), (4, None), (5, text("f")), (5, text("f", " x")), (5, text("f", " y")),
        (None, text("g")), (None, text("g", " x")), (6, text("h", " x")), (7, text("h")), (7, text("h")), (None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()]
    groups = {}
    for row in rows:
        if row[1]:
            groups.setdefault(row[1][0], set()).add(row)
    blank = [row for row in rows if not row[1]]
    assert len(kept) == len(groups) + len(blank) and all(kept.count(row) == blank.count(row) for row in blank)
    for group in groups.values():
        left = [row for row in kept if row in group]
        named = [row for row in group if row[0] is not None]
        assert len(left) == 1 and (not named or left[0][0] == min(named)[0])
    again = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs.repartition(2)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, kept))


def test_components_against_loops(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert found == {x: c for x, c in least.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_stars(spark):
    """Edges that are components already, given twice and both ways, or none at all."""
    edges = [(1, 5), (5, 1), (6, 1), (2, 9), (9, 2), (3, 3)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 5: 1, 6: 1, 2: 2, 9: 2}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated strings ----------------------------------------------------------------


def brute_repeats(rows):
    first = {}
    for name, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        for i in range(len(data) - 99):
            first.setdefault(data[i : i + 100], (name, i))
    out = []
    for name, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if first[data[i : i + 100]] < (name, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((name, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot, piece", [(repeats.HOT, repeats.PIECE), (2, 300)])
def test_repeats_against_all_windows(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["the", "éa", "of", "über", "x"]) + rng.choice("abcdefgh") for _ in range(n))
    bases = [words(60) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 99), (4, "a" * 400), (5, "ab" * 300)]
    for i in range(6, 90):
        base, cut = rng.choice(bases), rng.randint(0, 120)
        rows.append((i, rng.choice([base, words(rng.randint(0, 40)), words(9) + base[cut : cut + rng.randint(80, 220)] + words(3), base + "\n" + base])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = repeats.remove_repeats(docs)
    assert sorted(map(tuple, found.drop("kept").collect())) == brute_repeats(rows)


def test_repeats_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "q" * 50 + "x" * 60)] * 2 + [(None, "q" * 50 + "x" * 60)], "doc_id long, text string")
    rows = sorted((str(r.doc_id), r.n_removed) for r in repeats.remove_repeats(docs).collect())
    assert rows == [("1", 110), ("1", 110), ("None", 0)]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


# --- packing and mixing -----------------------------------------------------------------


def test_pieces_are_packed_whole(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.choice([0, 1, 500, 3000, 9000, 40_000])) for i in range(60)] + [(60, None), (7, "y" * 10), (7, "y" * 10)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bin_id int")
    found = packing.pack(docs, shard=20).toPandas()
    whole = found.groupby("doc_id").n_units.sum()
    for name, text in rows[:60]:
        assert name == 7 or whole[name] == (len(text) + 1 if text else 0)
    assert found[found.n_units == 0].bin_id.isna().all() and found.n_units.max() <= packing.LENGTHS[-1]
    for _, held in found[found.n_units > 0].groupby("bin_id"):
        held = held.sort_values("bin_offset")
        assert (held.bin_offset.to_numpy()[1:] >= (held.bin_offset + held.n_units).to_numpy()[:-1]).all()
        length, used = held.bin_length.iloc[0], int((held.bin_offset + held.n_units).max())
        assert length == next(n for n in packing.LENGTHS if n >= used) and held.n_units.sum() == used
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_is_near_the_lower_bound():
    rng = random.Random(9)
    sizes = sorted((rng.randint(1, 16384) for _ in range(2000)), reverse=True)
    bins, _, final = packing.best_fit(sizes)
    assert sum(final) < 1.05 * sum(sizes) and len(bins) == 2000
    assert packing.best_fit([]) == ([], [], [])


def test_mixture_means_follow_the_weights(spark):
    rows = [(i, "x" * 10, "a" if i % 3 else "b", 5) for i in range(3000)] + [(3000, None, None, 5), (3001, "", "empty", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    rated = mixing.rates(docs, weights={"a": 1, "b": 3}, epochs=2.0)
    rate = {r.source_key: r.rate for r in rated.collect()}
    assert rate["a"] == pytest.approx(2 * 0.25 * 3000 / 2000) and rate["b"] == pytest.approx(2 * 0.75 * 3)
    out = mixing.replicate(docs, rated)
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert counts["a"] == pytest.approx(1500, rel=0.1) and counts["b"] == pytest.approx(4500, rel=0.1)
    again = mixing.replicate(docs.repartition(3), rated)
    key = lambda df: sorted((r.doc_id, r.copy, r.mix_key) for r in df.collect())
    assert key(out) == key(again) and out.columns == ["doc_id", "text", "source", "n_copies", "copy", "mix_key"]
    variance = out.groupBy("doc_id", "source").count().where("source = 'b'").agg(F.variance("count")).first()[0]
    assert variance == pytest.approx(4.5, rel=0.25)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [70, 10_000])
def test_small_sources_reach_large_weights(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    rows = [(i, "x" * 10, "large") for i in range(2000)] + [(2000 + i, "x" * 10, "small") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rated = mixing.rates(docs, weights={"large": 1, "small": 1})
    rate = {r.source_key: r.rate for r in rated.collect()}
    assert rate["small"] == pytest.approx(2004 / 2 / 4) and rate["large"] == pytest.approx(2004 / 2 / 2000)
    out = mixing.replicate(docs, rated).collect()
    copies = {}
    for row in out:
        copies.setdefault(row.doc_id, []).append(row)
    for found in copies.values():
        assert sorted(r.copy for r in found) == list(range(1, found[0].n_copies + 1))
    counts = [len(copies[2000 + i]) for i in range(4)]
    assert all(abs(c - 250.5) < 5 * 250.5**0.5 for c in counts) and len(set(counts)) > 1
    again = mixing.replicate(docs.repartition(3), rated).collect()
    assert sorted((r.doc_id, r.copy, r.mix_key) for r in again) == sorted((r.doc_id, r.copy, r.mix_key) for r in out)


def test_sum_of_draws_is_poisson(spark):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(2000)], "doc_id long, text string, source string")
    rated = mixing.rates(docs, epochs=150.0)
    counts = mixing.replicate(docs, rated).groupBy("doc_id").count()
    mean, variance = counts.agg(F.avg("count"), F.variance("count")).first()
    assert mean == pytest.approx(150, rel=0.01) and variance == pytest.approx(150, rel=0.2)
    limited = mixing.rates(docs, epochs=150.0, max_rate=120.0).first()
    assert limited.rate == 120 and limited.draws == 2


# --- neighbours -------------------------------------------------------------------------


def test_radii_miss_no_code():
    rng = random.Random(10)
    cuts = hamming.substrings(64)
    for radius in (0, 3, 7, 28, 29):
        near = hamming.radii(radius, len(cuts))
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any((flips >> a & (1 << n) - 1).bit_count() <= near[i] for i, (a, n) in enumerate(cuts))


@pytest.mark.parametrize("n, tile", [(60, 16_384), (3000, 200)])
def test_neighbours_against_all(spark, monkeypatch, n, tile):
    monkeypatch.setattr(hamming, "TILE", tile)
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(n, 24)) * rng.uniform(0.5, 2, size=(n, 1))
    vectors[5:15] = vectors[4]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(n, None, "x"), (n + 1, [0.0] * 24, "x"), (n + 2, [float("nan")] * 24, "x"), (n + 3, [1.0], "x"), (0, vectors[0].tolist(), "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    found = hamming.neighbours_query(table).toPandas()
    hits = total = 0
    for query, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        scores = (vectors * vectors[query]).sum(axis=1)
        scores[query] = -np.inf
        best = np.lexsort((np.arange(n), -scores))[:20]
        hits += len(set(best) & set(own.vec_id))
        total += len(best)
        assert list(own["rank"]) == list(range(1, len(own) + 1)) and len(own) == min(20, n - 1)
        assert np.array_equal(own.score.to_numpy(), scores[own.vec_id.to_numpy()])
    assert sorted(found.query_id.unique()) == list(range(0, n, 20)) and hits / total >= 0.9
    assert hamming.neighbours_query(table.limit(0)).count() == 0


def test_equal_codes_count_once(spark):
    one = np.ones(2).tobytes()
    codes = [0] * 50 + [1, 1, 3, 65535]
    rows = [(i, bytearray(one), c, i in (0, 50, 52, 53)) for i, c in enumerate(codes)]
    base = spark.createDataFrame(rows, "vec_id long, vector binary, code long, counts boolean")
    queries = spark.createDataFrame([(99, bytearray(one), 0)], "vec_id long, vector binary, code long")
    model = hamming.Codes(2, 1.0, np.zeros((3, 16)), np.zeros(16))
    found = hamming._round(base, queries, model, 20, 4).groupBy("query_id").agg(F.sum("hits").alias("hits")).collect()
    assert [tuple(r) for r in found] == [(99, 3)]


def test_first_radius_follows_the_vectors(spark, monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(hamming, "DEPTH", 5)
    vectors = rng.normal(size=(13, 64))[np.arange(2600) % 13] + 0.5 * rng.normal(size=(2600, 64))
    asked = []
    search = hamming._round
    monkeypatch.setattr(hamming, "_round", lambda base, queries, model, k, radius: asked.append(radius) or search(base, queries, model, k, radius))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = hamming.neighbours(table, F.col("vec_id") % 100 < 2).toPandas()
    assert asked[0] < round(hamming.RADII[0] * 64)
    hits = 0
    for query, own in found.groupby("query_id"):
        scores = vectors @ vectors[query]
        scores[query] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & set(own.vec_id))
    assert found.query_id.nunique() == 52 and len(found) == 52 * 20 and hits / len(found) >= 0.9
    assert hamming.neighbours(table, F.lit(False)).count() == 0


def test_few_codes_do_not_end_a_search_short_of_rows(spark):
    here = np.random.default_rng(16).normal(size=64)
    rows = [(i, (here if 10 < i <= 20 else -here).tolist()) for i in range(600)]
    found = hamming.neighbours_query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert dict(found.query_id.value_counts()) == {i: 20 for i in range(0, 600, 20)}
    own = found[found.query_id == 20].sort_values("rank")
    assert list(own.vec_id) == [*range(11, 20), *range(11)]


def test_first_radius_holds_neighbours_and_codes(spark, monkeypatch):
    monkeypatch.setattr(hamming, "PROBES", 40)
    rng = np.random.default_rng(13)
    vectors = rng.normal(size=(600, 8))
    codes = (vectors > 0) @ (1 << np.arange(8))
    counts = np.isin(np.arange(600), np.unique(codes, return_index=True)[1])
    rows = [(i, bytearray(v.tobytes()), int(c), bool(n)) for i, (v, c, n) in enumerate(zip(vectors, codes, counts))]
    base = spark.createDataFrame(rows, "vec_id long, vector binary, code long, counts boolean").repartition(3)
    model = hamming.Codes(8, 1.0, np.zeros((9, 8)), np.zeros(8))
    apart = np.bitwise_count(codes[:40, None] ^ codes)
    scores = vectors[:40] @ vectors.T
    scores[np.arange(40), np.arange(40)] = -np.inf
    near = np.take_along_axis(apart, np.argsort(-scores, axis=1)[:, :20], axis=1)
    for wanted in (1, 100, 200):
        enough = [((apart[:, counts] <= r).sum(axis=1) >= wanted).mean() >= 0.95 and (near <= r).mean() >= 0.95 for r in range(9)]
        assert hamming.measured(base, base.where("vec_id < 40"), model, 20, wanted) == enough.index(True)


def test_tile_finds_what_its_substring_is_first_to_find():
    rng = np.random.default_rng(14)
    codes = rng.integers(0, 1 << 32, 4000, dtype=np.uint64)
    codes[1000:2000] ^= codes[:1000] & np.uint64(0x01010101)
    cuts = hamming.substrings(32)
    first, width = cuts[1]
    for radius, low in ((2, 16), (5, 14), (13, 15), (32, 13)):
        near = hamming.radii(radius, 2)
        slot = 1
        held = codes[codes >> np.uint64(first + low) == slot] if low < width else codes
        slot = slot if low < width else 0
        queries = codes[:1200:40]
        parts = [np.bitwise_count((queries[:, None] ^ held) >> np.uint64(a) & np.uint64((1 << n) - 1)) for a, n in cuts]
        expected = (parts[0] + parts[1] <= radius) & (parts[0] > near[0]) & (parts[1] <= near[1])
        reached = np.bitwise_count((queries >> np.uint64(first + low)) ^ np.uint64(slot)) <= near[1] if low < width else np.full(len(queries), True)
        tile = hamming._Tile(held, first, low)
        for want, found in zip(expected[reached], tile.probe(queries[reached], 1, slot, cuts, near, radius)):
            assert sorted(tile.order[found]) == list(np.flatnonzero(want))


def test_blocks_of_queries_and_salted_tiles_find_all_codes(spark, monkeypatch):
    monkeypatch.setattr(hamming, "TILE", 100)
    monkeypatch.setattr(hamming, "QUERIES", 7)
    rng = np.random.default_rng(15)
    codes = rng.integers(0, 1 << 31, 900)
    codes[:300] = codes[0] ^ (1 << rng.integers(0, 31, 300))
    one = bytearray(np.ones(2).tobytes())
    counts = np.isin(np.arange(900), np.unique(codes, return_index=True)[1])
    base = spark.createDataFrame([(i, one, int(c), bool(n)) for i, (c, n) in enumerate(zip(codes, counts))], "vec_id long, vector binary, code long, counts boolean")
    queries = spark.createDataFrame([(1000 + i, one, int(c)) for i, c in enumerate(codes[:900:30])], "vec_id long, vector binary, code long")
    model = hamming.Codes(2, 1.0, np.zeros((3, 32)), np.zeros(32))
    for radius in (2, 11):
        found = hamming._round(base, queries, model, 5, radius).groupBy("query_id").agg(F.sum("hits").alias("hits")).collect()
        ball = (np.bitwise_count(codes[:900:30, None] ^ codes) <= radius)[:, counts].sum(axis=1)
        assert {r.query_id: r.hits for r in found} == {1000 + i: int(n) for i, n in enumerate(ball) if n}


# --- revisits ---------------------------------------------------------------------------


def test_revisits(spark):
    rows = [
        (1, "response", "http://A.com:80", 10, {"etag": '"x"', "set-cookie": "1", "date": "d"}, "p1"),
        (2, "response", "http://a.com/", 20, {"etag": 'W/"y"'}, "p2"),
        (3, "revisit", "HTTP://a.com/#f", 15, {"etag": '"x"', "set-cookie": "2", "date": "e"}, None),
        (4, "revisit", "http://a.com/", 20, {"etag": '"x"'}, None),
        (5, "revisit", "http://a.com/", 90_000, {"etag": '"y"'}, None),
        (6, "revisit", "http://a.com/", 90_000, None, None),
        (7, "revisit", "http://b.com/", 9, {}, None),
        (8, "revisit", None, 9, {}, None),
        (9, "revisit", "http://a.com/", None, {"etag": '"y"'}, None),
        (10, "revisit", "http://a.com/", 25, {"etag": '"x"'}, None),
        (11, "response", None, None, None, None),
        (5, "revisit", "http://a.com/", 90_000, {"etag": '"y"'}, None),
    ]
    schema = "record_id long, kind string, url string, date long, headers map<string,string>, digest string"
    records = spark.createDataFrame(rows, schema).withColumn("date", F.timestamp_seconds("date")).withColumn("span", F.lit(0))
    found = [(r.record_id, r.status, r.refers_to, r.digest, r.headers) for r in revisits.resolve(records).collect()]
    assert sorted(f[:3] for f in found if f[0] != 5) == [
        (3, "resolved", 1), (4, "resolved", 1), (6, "no_validator", 2), (7, "no_response", None), (8, "no_response", None),
        (9, "no_response", None), (10, "mismatch", 2),
    ]
    assert [f[1:4] for f in found if f[0] == 5] == [("resolved", 2, "p2")] * 2
    assert next(f[4] for f in found if f[0] == 3) == {"etag": '"x"', "set-cookie": "1", "date": "e"}
    assert revisits.resolve(records.limit(0)).count() == 0


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://Ex.Com:80/a?b=2&a=1#x", "http://ex.com/a?a=1&b=2"),
        ("https://e.com:443", "https://e.com/"),
        ("https://e.com:80/?", "https://e.com:80/"),
        ("not a url", "not a url"),
        (None, None),
    ],
)
def test_canonical_urls(one, url, expected):
    assert one(revisits.canonical_url(F.col("u")), u=url) == expected
