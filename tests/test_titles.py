"""Titles spelled differently, against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions.text import title_key
from paperloom.operators import titles


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def spelled(rng, key):
    letters = list(key)
    for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
        at = rng.randrange(len(letters) + 1)
        kind = rng.randrange(3)
        letters[at : at + (kind > 0)] = [rng.choice("abé")] if kind < 2 else []
    return "".join(letters)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_near_keys_against_all_pairs(spark, most):
    rng = random.Random(most)
    held = {"".join(rng.choice("abé ") for _ in range(rng.choice([3, 7, 8, 9, 15, 16, 17, 24, 25, 40]))) for _ in range(90)}
    keys = {spelled(rng, key) for key in held for _ in range(3)} | {"", "a"}
    table = lambda values: spark.createDataFrame([(v,) for v in values], "key string")
    found = {tuple(row) for row in titles.near_keys(table(keys), table(held), most).collect()}
    expected = {
        (k, h, d) for k in keys for h in held if 0 < (d := plain_distance(k, h)) <= min(most, len(h) // titles.CHARS_PER_EDIT)
    }
    assert found == expected and len(expected) > 40


def test_title_key(one):
    key = title_key(F.col("t"))
    assert one(key, t="  A  Survey: of Édges (2nd\ted.)!") == "a survey of édges 2nd ed"
    assert one(key, t=" -- ") is None and one(key, t=None) is None


def test_first_source_with_any_hit_wins(spark):
    schema = "title string, year int, citation_count int, rank int"
    catalogs = {
        "semantic_scholar": spark.createDataFrame([("Deep Networks for Graph", 2001, 1, 0), (None, 1, 1, 0)], schema),
        "crossref": spark.createDataFrame(
            [("deep networks for graphs", 2002, 2, 1), ("Deep networks, for graphs", None, 3, 0), ("short", 2003, 4, 0)], schema
        ),
        "openalex": spark.createDataFrame([("Shore", 2004, 5, 0), ("Deep  Netwerks of Graphs", 2005, 6, 0)], schema),
    }
    rows = [(0, "Deep Networks for Graphs"), (1, "deep networks for graphs!"), (2, "SHORT."), (3, "shore?"), (4, None), (5, ""),
            (6, "short s"), (7, "Deep Netwerks of Graphs"), (8, "Nothing like it at all")]
    papers = spark.createDataFrame(rows, "ord long, title string")

    def found(order, most=2):
        done = titles.metadata_by_title(papers, catalogs, order=order, most=most)
        assert done.columns == ["ord", "title", "Year", "Citation_Count", "Metadata_Source"]
        return {r.ord: (r.Year, r.Citation_Count, r.Metadata_Source) for r in done.collect()}

    none = (None, 0, "not_found")
    near, same, other = (2001, 1, "semantic_scholar"), (None, 3, "crossref"), (2005, 6, "openalex")
    short, shore = (2003, 4, "crossref"), (2004, 5, "openalex")
    assert found(["semantic_scholar", "crossref", "openalex"]) == dict(enumerate([near, near, short, shore, none, none, none, other, none]))
    assert found(["crossref", "openalex"]) == dict(enumerate([same, same, short, shore, none, none, none, other, none]))
    assert found(["crossref"], most=0) == dict(enumerate([same, same, short, none, none, none, none, none, none]))


def test_no_titles(spark):
    empty = spark.createDataFrame([], "ord long, title string")
    catalog = spark.createDataFrame([], "title string, year int, citation_count int")
    assert titles.metadata_by_title(empty, {"openalex": catalog}).collect() == []
