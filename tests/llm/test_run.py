"""The whole pipeline on a small fixture, against plain loops over all of it."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import packing
from tests.llm.test_tables import brute_groups

#: What is planted, and what masking makes of it.
PRIVATE = {
    "a.b@example.org": "<EMAIL>",
    "10.20.30.40": "<IP>",
    "4524132264652876": "<CARD>",
    "+1 (269) 555-3296": "<PHONE>",
    "password=b7db7aa4a5fcc78305": "<SECRET>",
    "token = correcthorsebattery": "<SECRET>",
}


def fixture():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 7)))
    bases = [[word() for _ in range(rng.choice([25, 60, 200]))] for _ in range(8)]
    rows = []
    for i in range(120):
        kind = rng.random()
        words = list(rng.choice(bases)) if kind < 0.4 else [word() for _ in range(rng.choice([5, 30, 80, 400]))]
        for _ in range(rng.choice([0, 1, 2, 9])):
            words[rng.randrange(len(words))] = word()
        if kind > 0.5:
            for secret in rng.sample(list(PRIVATE), rng.randint(0, 3)):
                words.insert(rng.randrange(len(words)), secret + " and so")
        if kind > 0.9:
            words = [rng.choice([w.upper(), "# $ % &", "x" * 90]) for w in words]
        if 0.8 < kind < 0.9:
            words = words[:9] * 6
        rows.append((i, " ".join(words), rng.choice(["web", "web", "web", "books", None])))
    rows += [(200, None, "web"), (201, "", "books"), (202, "\n".join(["the same line"] * 30), "web")]
    rows += [(203, " ".join(word() for _ in range(6000)), "books")]
    return rows


def good(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(words) < 1000 else set()
    size = sum(map(len, words))
    return not (
        len(words) < 20
        or 100 * len(covered) > 30 * len(words)
        or 100 * sum(c in "#*$%&|<>" for c in text) > 10 * size
        or 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
        or 100 * sum("A" <= c <= "Z" for c in text) > 50 * size
        or size > 40 * len(words)
    )


def masked(text):
    for secret, name in PRIVATE.items():
        text = text.replace(secret, name)
    return text


def copies(rows):
    """Poisson counts of ``(id, text, source)`` by inversion at a hash of the id."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text)
    weights = {source: size**0.7 for source, size in sizes.items()}
    found = {}
    for name, _, source in rows:
        rate = weights[source] * sum(sizes.values()) / sum(weights.values()) / sizes[source]
        u = (int(hashlib.md5(f"mixture|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate)
        below = p
        while below < u:
            k += 1
            p *= rate / k
            below += p
        found[name] = k
    return found


def test_run_against_loops(spark, tmp_path):
    rows = fixture()
    table = [(i, text, "en", source, len(text) if text is not None else None) for i, text, source in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    left = [row for row in rows if good(row[1])]
    least = {name: group for name, _, group in brute_groups([row[:2] for row in left], 5, 80)}
    distinct = [row for row in left if least[row[0]] == row[0]]
    anonymous = [(name, masked(text), source) for name, text, source in distinct]
    counts = copies(anonymous)
    assert len(rows) > len(left) > len(distinct) > 0 and anonymous != distinct and len(set(counts.values())) > 2

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    units = {}
    for row in found:
        units[row.doc_id] = units.get(row.doc_id, 0) + row.n_units
    assert units == {name: counts[name] * (len(text.encode()) + 1) for name, text, _ in anonymous if counts[name]}
    # Each piece as often as its document, bins long enough and without overlap.
    bins = {}
    for row in found:
        assert sum((r.doc_id, r.start) == (row.doc_id, row.start) for r in found) == counts[row.doc_id]
        bins.setdefault(row.bin_id, []).append(row)
    for held in bins.values():
        at = 0
        for row in sorted(held, key=lambda r: r.bin_offset):
            assert row.bin_offset >= at and row.bin_length in packing.LENGTHS
            at = row.bin_offset + row.n_units
        assert at <= held[0].bin_length


def test_masked_texts_against_replacing(spark, tmp_path):
    rows = [(i, text, source) for i, text, source in fixture() if good(text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.text for r in corpus_pipeline.anonymous(spark, docs, "").collect()}
    assert found == {name: masked(text) for name, text, _ in rows}


CLASHING = (
    "_id _hash _source _own _cdf _draws _drawn _chunk _masked _before _row _number _text _words row key node n "
    "hash copy n_copies mix_key cdf draws source_key masked component shingle measures failed"
).split()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_columns_of_any_name(spark, name, stage):
    rows = [(i, text, source) for i, text, source in fixture()]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = stage(spark, plain, "")
    found = stage(spark, plain.select("*", *[F.lit(c).alias(c) for c in CLASHING]), "")
    if name != "packing":
        assert found.columns == plain.columns + CLASHING
        assert all(row[c] == c for row in found.select(*CLASHING).distinct().collect() for c in CLASHING)
    assert sorted(map(str, found.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
