"""Packing against a plain best-fit loop over all bins."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import packing


def plain_fit(sizes, lengths, cost):
    """Bins as ``[length, sizes]``: each size goes to the bin with least room, of equal ones the one used last."""
    best = None
    for top in lengths:
        need = min((n for n in lengths if not sizes or n >= max(sizes)), default=lengths[-1])
        allowed = [n for n in lengths if n <= max(top, need)]
        bins, rest = [], sum(sizes)
        for turn, size in enumerate(sorted(sizes, reverse=True)):
            fitting = [b for b in bins if b["length"] - sum(b["held"]) >= size]
            if fitting:
                chosen = min(fitting, key=lambda b: (b["length"] - sum(b["held"]), -b["turn"]))
            else:
                # The cheapest length for what it can still hold, and of these the largest.
                length = min((n for n in allowed if n >= size), key=lambda n: (cost[n] / min(n, rest), -n))
                chosen = {"length": length, "held": [], "turn": 0}
                bins.append(chosen)
            chosen["held"].append(size)
            chosen["turn"] = turn
            rest -= size
        final = [(min(n for n in allowed if n >= sum(b["held"])), tuple(b["held"])) for b in bins]
        price = sum(cost[n] for n, _ in final)
        if best is None or price < best[0]:
            best = (price, final)
    return sorted(best[1])


def packed(sizes, lengths, cost):
    bins, _, final = packing.best_fit(sorted(sizes, reverse=True), lengths, cost)
    held = {}
    for b, size in zip(bins, sorted(sizes, reverse=True)):
        held.setdefault(b, []).append(size)
    return sorted((final[b], tuple(inside)) for b, inside in held.items())


@pytest.mark.parametrize("lengths", [(10,), (8, 16, 64), (5, 7, 30)])
def test_best_fit_against_plain_loop(lengths):
    rng = random.Random(sum(lengths))
    for _ in range(300):
        sizes = [rng.randrange(1, lengths[-1] + 1) for _ in range(rng.randrange(0, 60))]
        sizes = [rng.choice(sizes) if rng.random() < 0.3 else n for n in sizes]
        cost = {n: n + rng.choice([0, 1, 5, 40]) for n in lengths}
        assert packed(sizes, list(lengths), cost) == plain_fit(sizes, list(lengths), cost)


def test_query_against_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(0, 9_000) if i % 3 else "x" * rng.randrange(0, 60_000)) for i in range(120)]
    rows += [(None, "abc"), (7, None), (8, ""), (9, "same"), (9, "same")]
    docs = spark.createDataFrame([(*row, "s", 1) for row in rows], "doc_id long, text string, start string, bin_id int")
    found = packing.pack(docs.repartition(3)).collect()
    longest = packing.LENGTHS[-1]
    expected = []
    for name, text in rows:
        units = len((text or "").encode()) + 1 if text else 0
        expected += [(name, at, min(longest, units - at)) for at in range(0, max(units, 1), longest)]
    assert sorted(((r.doc_id, r.start, r.n_units) for r in found), key=str) == sorted(expected, key=str)
    bins = {}
    for row in sorted((r for r in found if r.n_units), key=lambda r: (r.bin_id, r.bin_offset)):
        length, held = bins.setdefault(row.bin_id, (row.bin_length, []))
        assert row.bin_length == length and row.bin_offset == sum(held)
        held.append(row.n_units)
    cost = {n: n + packing.PER_BIN for n in packing.LENGTHS}
    plain = plain_fit([n for _, _, n in expected if n], list(packing.LENGTHS), cost)
    assert sorted((length, tuple(held)) for length, held in bins.values()) == plain
    assert all(r.bin_id is None and r.bin_length is None and r.bin_offset is None for r in found if not r.n_units)
    assert packing.pack(docs.where(F.lit(False))).collect() == []
