import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import answers as A

GOOD = '{"categories":{"C":"d"},"classifications":{"T":"C"}}'


@pytest.mark.parametrize(
    "answer, expected",
    [
        ("x\n```json\n{1}\n```\ny", "{1}"),
        ("```json {1}``` ```json {2}```", "{1}"),
        ("say {a} and {b} end", "{a} and {b}"),
        ("{a\nb}", "{a\nb}"),
        ("plain", "plain"),
        ("} {", ""),
        ("```json\n{1}", "{1"),
        ("```json", ""),
        ("", ""),
        (None, None),
    ],
)
def test_json_slice(one, answer, expected):
    assert one(A.json_slice(F.col("a")), a=answer) == expected


@pytest.mark.parametrize(
    "text, ok, categories, classes",
    [
        (GOOD, True, {"C": "d"}, {"T": "C"}),
        ("{}", True, {}, {}),
        ('{"classifications":{"T":"C"}}', True, {}, {"T": "C"}),
        ('{"categories":null}', True, {}, {}),
        ('{"categories":{"a":1,"b":{"z":2}}}', True, {"a": "1", "b": '{"z":2}'}, {}),
        ('{"classifications":{"T":"a","U":"x","T":"b"}}', True, {}, {"U": "x", "T": "b"}),
        ('{"classifications":{"a\\"b\\u00e9":"c"}}', True, {}, {'a"bé': "c"}),
        ('{"categories":[1]}', False, None, None),
        ('{"categories":"x"}', False, None, None),
        ('{"classifications":[1]}', False, None, None),
        (GOOD + " tail", False, None, None),
        (GOOD + "," + GOOD, False, None, None),
        ('{"categories":{"C":"d"},}', False, None, None),
        ("{'categories':{}}", False, None, None),
        ("[1]", False, None, None),
        ('"text"', False, None, None),
        ("", False, None, None),
        (None, False, None, None),
    ],
)
def test_parse_classification(one, text, ok, categories, classes):
    found = one(A.parse_classification(F.col("t")), t=text)
    if found is None:
        found = (False, None, None)
    assert tuple(found) == (ok, categories, classes)


@pytest.mark.parametrize(
    "answer, expected",
    [
        ([[["Hal", "hel", None], ["lo", "lo"]], None, "en"], "Hallo"),
        ([[["a", "x"], [None, "y"], ["", "z"], ["b", "w"]]], "ab"),
        ([[[None, "y"]]], ""),
        ([None, "x"], "orig"),
        ([[]], "orig"),
        ([], "orig"),
    ],
)
def test_parse_translation(one, answer, expected):
    assert one(A.parse_translation(F.col("a"), F.lit("orig")), a=json.dumps(answer)) == expected


@pytest.mark.parametrize("answer", ["null", "{}", " { } ", "[]", '""'])
def test_translation_that_holds_nothing(one, answer):
    assert one(A.parse_translation(F.col("a"), F.lit("orig")), a=answer) == "orig"


@pytest.mark.parametrize("answer", ["{broken", None])
def test_unreadable_translation(one, answer):
    assert one(A.parse_translation(F.col("a"), F.lit("orig")), a=answer) is None


@pytest.mark.parametrize(
    "source, answer, expected",
    [
        ("semantic_scholar", {"data": [{"year": 2020, "citationCount": 7}, {"year": 1}]}, (2020, 7)),
        ("semantic_scholar", {"data": [{"citationCount": 7}]}, (None, 7)),
        ("semantic_scholar", {"data": [{"year": 2020}]}, (2020, 0)),
        ("semantic_scholar", {"data": []}, None),
        ("semantic_scholar", {}, None),
        ("crossref", {"message": {"items": [{"issued": {"date-parts": [[2019, 5]]}}]}}, (2019, 0)),
        (
            "crossref",
            {"message": {"items": [{"published-online": {"date-parts": [[2018]]}, "issued": {"date-parts": [[2017]]}}]}},
            (2018, 0),
        ),
        (
            "crossref",
            {"message": {"items": [{"published-print": {"date-parts": [[None]]}, "issued": {"date-parts": [[2017]]}}]}},
            (2017, 0),
        ),
        (
            "crossref",
            {"message": {"items": [{"published-print": {"date-parts": [[0]]}, "published-online": {"date-parts": []}}]}},
            (None, 0),
        ),
        ("crossref", {"message": {"items": [{"title": "x"}]}}, (None, 0)),
        ("crossref", {"message": {"items": []}}, None),
        ("crossref", {}, None),
        ("openalex", {"results": [{"publication_year": 2001, "cited_by_count": 3}]}, (2001, 3)),
        ("openalex", {"results": [{"publication_year": 2001}]}, (2001, 0)),
        ("openalex", {"results": []}, None),
    ],
)
def test_parse_metadata(one, source, answer, expected):
    found = one(A.METADATA_PARSERS[source](F.col("a")), a=json.dumps(answer))
    assert (found and tuple(found)) == (expected and (*expected, source))


def test_unreadable_metadata(one):
    for parser in A.METADATA_PARSERS.values():
        assert one(parser(F.col("a")), a="oops") is None
        assert one(parser(F.col("a")), a=None) is None
