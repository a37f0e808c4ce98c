"""Answers kept across runs."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.operators import enrich, metadata
from paperloom.operators.answer_store import AnswerStore
from paperloom.plans.paper_qa import answer_table


def recording(folder, fails=lambda text, n: None):
    """A service that leaves a file for each call; ``fails`` gets the text and the calls so far."""
    folder = Path(folder)
    folder.mkdir(exist_ok=True)

    def service():
        import uuid

        def send(text):
            problem = fails(text, len(list(folder.iterdir())))
            (folder / uuid.uuid4().hex).write_text(text)
            if problem:
                raise problem
            return text.upper()

        return send

    return service, lambda: sorted(file.read_text() for file in folder.iterdir())


def rows(spark, n=40):
    return spark.range(4 * n).select(F.col("id").alias("ord"), F.concat(F.lit("t"), F.col("id") % n).alias("text"))


def answers(spark, service, store, **options):
    found = enrich.enrich(rows(spark), F.col("text"), service, ["ord"], store=store, **options)
    return {row.ord: (row.answer, row.answer_error) for row in found.collect()}


EXPECTED = {number: (f"T{number % 40}", None) for number in range(160)}


def test_a_service_that_fails_after_half_answers_nothing_twice(spark, tmp_path):
    store = AnswerStore(str(tmp_path / "store"), wave=20)
    half, first = recording(tmp_path / "one", lambda text, n: RuntimeError("down") if int(text[1:]) >= 20 else None)
    found = answers(spark, half, store, parallelism=2)
    assert {number for number, (_, error) in found.items() if error == "down"} == {n for n in range(160) if n % 40 >= 20}
    whole, second = recording(tmp_path / "two")
    assert answers(spark, whole, store, parallelism=2) == EXPECTED
    assert second() == sorted(f"t{number}" for number in range(20, 40)) and len(first()) == 40
    # A third run asks nothing at all.
    third, none = recording(tmp_path / "three")
    assert answers(spark, third, store) == EXPECTED and none() == []


def test_a_broken_run_loses_its_last_wave_only(spark, tmp_path):
    store = AnswerStore(str(tmp_path / "store"), wave=10)
    # The worker dies with its task, and the run with it, after half of the calls.
    dying, first = recording(tmp_path / "one", lambda text, n: SystemExit(1) if n >= 20 else None)
    with pytest.raises(Exception):
        answers(spark, dying, store, parallelism=1)
    kept = {row.request for row in store.read(spark).collect()}
    whole, second = recording(tmp_path / "two")
    assert answers(spark, whole, store, parallelism=1) == EXPECTED
    assert 0 < len(kept) <= 20 and len(second()) == 40 - len(kept) and len(set(second())) == len(second())


def test_other_options_columns_and_services_are_other_requests(spark, tmp_path):
    store = AnswerStore(str(tmp_path / "store"))
    service, calls = recording(tmp_path / "calls")
    for language in ("de", "en", "de"):
        answers(spark, service, store, language=language)
    answers(spark, service, store.part("other"), language="de")
    assert len(calls()) == 3 * 40
    asked = spark.createDataFrame([("a", 5), ("a", 6), ("a", 5)], "text string, max_tokens int")
    for _ in range(2):
        found = enrich.ask(asked, "text", service, None, ["max_tokens"], store)
        assert sorted(tuple(row) for row in found.collect()) == [("a", 5, "A", None), ("a", 5, "A", None), ("a", 6, "A", None)]
    assert len(calls()) == 3 * 40 + 2


def test_failures_can_be_final(spark, tmp_path):
    store = AnswerStore(str(tmp_path / "store"), retry_failed=False)
    down, _ = recording(tmp_path / "one", lambda text, n: RuntimeError("no"))
    answers(spark, down, store)
    whole, calls = recording(tmp_path / "two")
    assert set(answers(spark, whole, store).values()) == {(None, "no")} and calls() == []


def test_nothing_to_ask(spark, tmp_path):
    store = AnswerStore(str(tmp_path / "store"))
    service, calls = recording(tmp_path / "calls")
    empty = enrich.enrich(rows(spark).where("ord < 0"), F.col("text"), service, ["ord"], store=store)
    nulls = enrich.enrich(rows(spark).withColumn("text", F.lit(None).cast("string")), F.col("text"), service, ["ord"], store=store)
    assert empty.collect() == [] and nulls.where("answer is null").count() == 160 and calls() == []


def test_plans_keep_answers(spark, tmp_path):
    store = AnswerStore(str(tmp_path / "store"))
    service, calls = recording(tmp_path / "calls")
    pages = spark.createDataFrame([("d", 0, "some text"), ("e", 0, "")], "doc_id string, page_no int, text string")
    first, second = (answer_table(pages, ["Why?", "How?"], service, store=store).orderBy("doc_id").collect() for _ in range(2))
    assert first == second and len(calls()) == 2
    titles = spark.createDataFrame([("x",), ("y",)], "title string")
    for _ in range(2):
        found = metadata.metadata_from_services(titles, {"crossref": service, "openalex": service}, store=store.part("metadata"))
        assert found.collect() == []
    assert len(calls()) == 2 + 2 * 2
