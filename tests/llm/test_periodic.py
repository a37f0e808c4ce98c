"""Runs of words against plain loops over all lags."""

import hashlib
import random
import zlib

import pytest

from paperloom.llm import periodic


def plain_runs(words, least=12):
    n, found = len(words), {}
    for lag in range(1, n // 2 + 1):
        at = lag
        while at < n:
            if words[at] != words[at - lag]:
                at += 1
                continue
            end = at
            while end < n and words[end] == words[end - lag]:
                end += 1
            stretch = (at - lag, end - at + lag)
            if stretch[1] >= max(least, 2 * lag) and stretch not in found:
                found[stretch] = lag
            at = end
    return sorted((start, length, lag) for (start, length), lag in found.items())


def repetitive(rng, n, letters):
    words = []
    while len(words) < n:
        kind = rng.random()
        if kind < 0.3 or not words:
            words += [rng.randrange(letters) for _ in range(rng.randrange(1, 20))]
            continue
        some = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        if kind > 0.6:
            at = rng.randrange(len(words))
            some = words[at : at + rng.randrange(1, 60)]
        if kind > 0.8:
            some[rng.randrange(len(some))] = rng.randrange(letters)
        words += (some * rng.randrange(1, 8))[: rng.randrange(1, 200)]
    return words


@pytest.mark.parametrize("least", [4, 6, 12, 16])
def test_runs_against_all_lags(least):
    rng = random.Random(least)
    for _ in range(400):
        words = repetitive(rng, rng.choice([5, 30, 150, 400]), rng.choice([1, 2, 3, 4, 30]))
        assert periodic.runs_of(words, least) == plain_runs(words, least)


def test_runs_of_words_rich_in_repeats():
    one, two = "a", "ab"
    for _ in range(12):
        one, two = two, two + one
        assert periodic.runs_of(list(two)) == plain_runs(list(two))
    turning = [bin(i).count("1") % 2 for i in range(700)]
    assert periodic.runs_of(turning) == plain_runs(turning)
    assert periodic.runs_of(["x"] * 50_000) == [(0, 50_000, 1)]
    assert periodic.runs_of([i % 20 for i in range(20_000)]) == [(0, 20_000, 20)]


def test_all_but_the_first_period_of_a_run_goes():
    words = list("qabcabcabcabcabz") + ["x"] * 12
    runs = periodic.runs_of(words)
    assert runs == [(1, 14, 3), (16, 12, 1)]
    assert "".join(periodic.keep_once(words, runs)) == "qabczx"


def test_odd_rows(spark):
    row = "one two three four\x0b" * 5
    rows = [
        (1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, "é\xa0é ü", 0), (5, row, 0), (5, row, 1), (None, row, 0),
        (6, "w " * 30_000 + "end", 0), (7, " ".join(str(i % 9_000) for i in range(20_000)), 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(2)
    found = {}
    for r in periodic.find_runs(docs).collect():
        found.setdefault(r.doc_id, []).append((r.n_words, [tuple(run) for run in r.runs], r.kept))
    assert found[1] == found[2] == found[3] == [(0, [], "")]
    assert found[4] == [(2, [], "é\xa0é ü")]
    assert found[5] == 2 * found[None] == 2 * [(20, [(0, 20, 4)], "one two three four")]
    assert found[6] == [(30_001, [(0, 30_000, 1)], "w end")]
    assert found[7][0][1] == [(0, 20_000, 9_000)] and len(found[7][0][2].split()) == 9_000
    assert periodic.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs(docs, least=5)


def test_query_against_loops(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(map(str, repetitive(rng, rng.choice([1, 40, 300]), 50)))) for i in range(150)]
    rows += [(None, rows[0][1]), (900, None), (901, "\n")]
    expected, tails = [], 0
    for name, text in rows:
        words = (text or "").split()
        checksum = zlib.crc32(str(name).encode()) if name is not None else 1
        if checksum % 10 == 0 and words:
            tails += 1
            g, n = checksum // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for start, length, period in runs for i in range(start + period, start + length)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        shown = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
        listed = sha("".join(f"{s},{length},{p}\n" for s, length, p in runs))
        expected.append((name, len(runs), *shown, listed, sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert tails > 5
    docs = spark.createDataFrame([(*row, 1, "x") for row in rows], "doc_id long, text string, _h int, kept string")
    found = [tuple(r) for r in periodic.runs_query(docs.repartition(3)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
