import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.operators import enrich
from paperloom.plans import csv_jobs
from paperloom.sources.files import read_papers, write_papers


@pytest.fixture
def recorder(tmp_path):
    """A service that leaves one file per call and fails on "bad"."""
    folder = str(tmp_path)

    def service():
        import uuid

        def send(text):
            Path(folder, uuid.uuid4().hex).write_text(text)
            if text == "bad":
                raise ValueError("no such thing")
            return text.upper()

        return send

    return service, lambda: sorted(file.read_text() for file in Path(folder).iterdir())


def test_each_payload_is_asked_once(spark, recorder):
    service, calls = recorder
    texts = ["a", "b", "a", None, "bad", "a", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    found = enrich.enrich(rows, F.col("text"), service, ["ord"])
    for _ in range(2):  # a second run must not ask again
        result = {row.ord: (row.answer, row.answer_error) for row in found.collect()}
    assert result == {
        0: ("A", None), 1: ("B", None), 2: ("A", None), 3: (None, None),
        4: (None, "no such thing"), 5: ("A", None), 6: ("", None), 7: (None, None),
    }
    assert calls() == ["", "a", "b", "bad"]


@pytest.mark.parametrize("parallelism", [None, 1, 8])
def test_parallelism_changes_nothing(spark, parallelism):
    rows = spark.range(200).select(F.col("id").alias("ord"), (F.col("id") % 17).cast("string").alias("text"))
    found = enrich.enrich(rows, F.col("text"), lambda: lambda text: text * 2, ["ord"], parallelism)
    assert {row.ord: row.answer for row in found.collect()} == {number: str(number % 17) * 2 for number in range(200)}


def test_services_are_told_what_they_have_parameters_for(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 6)], "text string, max_tokens int")

    def budgeted():
        return lambda text, max_tokens: f"{text}{max_tokens}"

    def everything():
        return lambda text, **told: text + json.dumps(told, sort_keys=True)

    def answers(service):
        return sorted(row.result for row in enrich.ask(rows, "text", service, None, ["max_tokens"], language="de").collect())

    assert answers(budgeted) == ["a5", "b6"]
    assert answers(lambda: str.upper) == ["A", "B"]
    assert answers(everything) == ['a{"language": "de", "max_tokens": 5}', 'b{"language": "de", "max_tokens": 6}']


def segments():
    def send(text):
        if text == "bad":
            raise RuntimeError("limit")
        return "broken" if text == "odd" else json.dumps([[["<" + text, "x"], [">", "y"]]])

    return send


def test_translate_abstracts(spark):
    rows = [(1, "one", None), (2, " \n", None), (3, None, "404"), (4, "bad", None), (5, "odd", None)]
    papers = spark.createDataFrame(rows, "ord long, abstract string, error string")
    done = enrich.translate_abstracts(papers, segments)
    assert done.columns == ["ord", "abstract", "error", "abstract_translate"]
    assert {row.ord: row.abstract_translate for row in done.collect()} == {
        1: "<one>", 2: "", 3: "", 4: "Translation failed: limit", 5: "Translation failed: unreadable answer"
    }


PAPERS = "title string, llm_summary string, abstract string, pdf_url string, arxiv_id string, url string"


def paper_file(spark, tmp_path):
    rows = [
        ("T, \"q\"\nline", "s1", "one", "", "1.2", "u1"),
        ("plain", "s2", " two\r\n lines ", None, "", "u2"),
    ]
    return write_papers(spark.createDataFrame(rows, PAPERS), str(tmp_path / "papers.csv"))


def test_csv_roundtrip(spark, tmp_path):
    found = read_papers(spark, paper_file(spark, tmp_path)).orderBy("url").collect()
    assert [tuple(row) for row in found] == [
        ("T, \"q\"\nline", "s1", "one", None, "1.2", "u1"),
        ("plain", "s2", " two\r\n lines ", None, None, "u2"),
    ]


def test_read_file_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("﻿title,llm_summary,abstract,pdf_url,arxiv_id,url\nä,\"a\"\"b\",,,,u\n".encode())
    assert tuple(read_papers(spark, str(path)).first()) == ("ä", 'a"b', None, None, None, "u")
    with pytest.raises(Exception, match="(?i)path"):
        read_papers(spark, str(tmp_path / "none.csv")).count()


def test_translate_csv(spark, tmp_path):
    done = csv_jobs.translate_csv(spark, paper_file(spark, tmp_path), str(tmp_path), segments)
    assert done.endswith("/papers_translated_zh_cn.csv")
    found = spark.read.csv(done, header=True, multiLine=True, escape='"')
    assert found.columns == [*read_papers(spark, str(tmp_path / "papers.csv")).columns, "abstract_translate"]
    assert {row.url: row.abstract_translate for row in found.collect()} == {
        "u1": "<one>", "u2": "< two\r\n lines >"
    }


def test_classify_csv(spark, tmp_path):
    def group():
        return lambda prompt: '{"categories":{},"classifications":{"plain":"P"}}'

    done = csv_jobs.classify_csv(spark, paper_file(spark, tmp_path), str(tmp_path), group, ["w"])
    assert done.endswith("/papers_classified.csv")
    found = spark.read.csv(done, header=True, multiLine=True, escape='"')
    assert {row.url: row.category for row in found.collect()} == {"u1": "Unclassified", "u2": "P"}
