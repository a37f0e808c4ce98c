import json
import re

import pytest
from pyspark.sql import functions as F

from paperloom.operators import batches
from paperloom.operators import categories as categories_module

TEMPLATE = "{keywords}|{num_categories}|\n{papers_info}"
SCHEMA = "ord long, search_key string, title string, llm_summary string"


@pytest.fixture
def papers(spark):
    rows = [(number, "k", f"t{number}", "s" * 20) for number in range(30)]
    rows += [(30, "k", "blank", "  \n"), (31, "k", None, "null title"), (32, "k", "t1", None), (40, "other", "o", "")]
    return spark.createDataFrame(rows, SCHEMA)


def brute_batches(rows, budget):
    """Batch of every paper by plain loops; chunks play no part."""
    found, used = {}, {}
    for row in sorted(rows, key=lambda row: row.ord):
        key = row.search_key
        if (row.llm_summary or "").strip():
            used[key] = used.get(key, 0) + len(f"Title: {row.title or ''}\nSummary: {row.llm_summary}\n\n")
        found[row.ord] = max((used.get(key, 0) - 1) // budget, 0)
    return found


@pytest.mark.parametrize("budget, chunk_ords", [(100, 1000), (100, 7), (1, 1000), (10**6, 10)])
def test_batches_against_loops(papers, budget, chunk_ords):
    found = {row.ord: row.batch for row in batches.prompt_batches(papers, budget, chunk_ords).collect()}
    assert found == brute_batches(papers.collect(), budget)


def test_context_keeps_order_and_skips_blanks(papers):
    for parts in (1, 8):
        batched = batches.prompt_batches(papers.repartition(parts), 10**6)
        rows = batches.batch_context(batched).collect()
        assert [(row.bucket, row.papers) for row in rows] == [("k", 31)]
        titles = re.findall("Title: (.*)", rows[0].papers_info)
        assert titles == [f"t{number}" for number in range(30)] + [""]
        assert rows[0].papers_info.endswith("Title: \nSummary: null title\n\n")


def test_prompt_and_budget(papers):
    context = batches.batch_context(batches.prompt_batches(papers, 10**6))
    row = batches.classification_prompts(context, ["x", "y"], 3, TEMPLATE).first()
    assert row.prompt.startswith("x, y|3|\nTitle: t0\n")
    assert (len(row.prompt) > 1000, row.max_tokens) == (True, 2000)
    short = batches.classification_prompts(context.withColumn("papers_info", F.lit("p")), ["x"], 3, TEMPLATE)
    assert short.first().max_tokens == 100


def answer_for(titles):
    return "```json\n" + json.dumps({"categories": {"even": "e"}, "classifications": titles}) + "\n```"


def by_number():
    def send(prompt):
        numbers = [int(number) for number in re.findall(r"Title: t(\d+)", prompt)]
        if 3 in numbers:
            raise RuntimeError("down")
        if 13 in numbers:
            return "no idea"
        return answer_for({f"t{number}": "even" for number in numbers if number % 2 == 0})

    return send


def test_failures_stay_in_their_batch(papers):
    done = batches.classify_papers(papers, by_number, ["w"], template=TEMPLATE, budget=410, chunk_ords=10)
    found = {row.ord: row.category for row in done.collect()}
    assert len(found) == 34
    assert {found[number] for number in range(10)} == {"Classification parsing failed: down"}
    assert {found[number] for number in range(10, 19)} == {"Classification parsing failed: no valid JSON"}
    assert [found[number] for number in (20, 21, 22)] == ["even", "Unclassified", "even"]
    # Blank summaries are not sent; a bucket with nothing to send gets no category.
    assert found[30] == "Unclassified"
    assert found[40] == ""


def test_blank_paper_shares_the_category_of_its_title(spark):
    papers = spark.createDataFrame([(1, "k", "t2", "s"), (2, "k", "t2", "")], SCHEMA)
    done = batches.classify_papers(papers, by_number, ["w"], template=TEMPLATE)
    assert {row.category for row in done.collect()} == {"even"}


def test_papers_without_a_search_are_one_bucket(spark):
    papers = spark.createDataFrame([(number, None, f"t{number}", "s") for number in (4, 6, 20)], SCHEMA)
    done = batches.classify_papers(papers, by_number, ["w"], template=TEMPLATE, chunk_ords=10)
    assert {row.ord: row.category for row in done.collect()} == {4: "even", 6: "even", 20: "even"}
    assert done.columns == papers.columns + ["category"] and done.where("search_key is null").count() == 3


def test_assign_category(spark):
    papers = spark.createDataFrame([(1, "a"), (2, "A"), (3, None), (4, "a")], "ord long, title string")
    table = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "title string, category string")
    found = batches.assign_category(papers, table)
    assert {row.ord: row.category for row in found.collect()} == {1: "y", 2: "Unclassified", 3: "Unclassified", 4: "y"}
    counts = {row.category: row.papers for row in batches.category_counts(found).collect()}
    assert counts == {"y": 2, "Unclassified": 2}


def merging(calls=None, fail=lambda prompt, first: False):
    """Names a category per paper and batch, and merges names by their first letter."""

    def service():
        import pathlib
        import uuid

        def send(prompt):
            first = not any(pathlib.Path(calls).iterdir()) if calls else False
            if calls:
                pathlib.Path(calls, uuid.uuid4().hex).write_text(prompt)
            if fail(prompt, first):
                raise RuntimeError("down")
            titles = re.findall("Title: (.*)", prompt)
            merged = {}
            for name in re.findall("^- (.*?): ", prompt, flags=re.MULTILINE):
                merged.setdefault(name[0], []).append(name)
            named = {t: f"{'abc'[int(t[1:]) % 3]}{t}" for t in titles}
            return json.dumps({"merged": merged} if merged else {"categories": {n: "x" for n in named.values()}, "classifications": named})

        return send

    return service


def categories(papers, service, budget=220, **options):
    done = batches.classify_papers(papers, service, ["w"], template=TEMPLATE, budget=budget, chunk_ords=10, **options)
    return {row.ord: row.category for row in done.collect()}


def test_batches_share_one_set_of_categories(spark, tmp_path):
    rows = [(number, "k", f"k{number}", "s") for number in range(60)] + [(number, "m", f"m{number}", "s") for number in range(5)]
    papers = spark.createDataFrame(rows, SCHEMA)
    expected = {number: "abc"[number % 3] for number in range(60)}
    found = categories(papers.where("search_key = 'k'"), merging(str(tmp_path)))
    assert found == expected
    # Several prompts for 60 names, each of a bounded number of them.
    merges = [text for text in (f.read_text() for f in tmp_path.iterdir()) if "- " in text]
    assert len(merges) >= 2 and all(len(re.findall("^- ", text, flags=re.MULTILINE)) < 60 for text in merges)
    # A search that fits one prompt keeps the names it was given.
    alone = categories(papers.where("search_key = 'm'"), merging())
    assert alone == {number: f"{'abc'[number % 3]}m{number}" for number in range(5)}
    # Numbering the papers the other way round puts them into other batches.
    turned = papers.where("search_key = 'k'").withColumn("ord", 59 - F.col("ord"))
    assert categories(turned, merging()) == {59 - number: name for number, name in expected.items()}


def test_failed_calls_do_not_break_the_categories(spark, tmp_path):
    papers = spark.createDataFrame([(number, "k", f"k{number}", "s") for number in range(60)], SCHEMA)
    # The first batch fails: its papers are marked, and the others share their categories.
    found = categories(papers, merging(fail=lambda prompt, first: "Title: k0\n" in prompt))
    failed = [number for number, name in found.items() if name == "Classification parsing failed: down"]
    assert 0 in failed and failed == list(range(len(failed))) and len(failed) < 60
    assert {name for number, name in found.items() if number not in failed} == {"a", "b", "c"}
    # Without any merge call every paper keeps the name its batch gave.
    found = categories(papers, merging(fail=lambda prompt, first: "- " in prompt))
    assert found == {number: f"{'abc'[number % 3]}k{number}" for number in range(60)}


def test_merge_replies_are_read_with_care(spark):
    rows = [("k", batch, name, None) for batch in (0, 1) for name in ("one", "two", "three", "four", "five")]
    rows += [("alone", 0, name, "x") for name in ("one", "two", "three")]
    found = spark.createDataFrame(rows, "bucket string, batch long, category string, about string")
    reply = {"merged": {" big ": ["one", "two", "unknown"], "": ["three"], "also": ["two", None], "none": None}}

    def merged(answer):
        done = categories_module.merge_categories(found, lambda: lambda prompt: answer, 2)
        return {(row.bucket, row.category): row.merged for row in done.collect()}

    same = {(bucket, name): name for bucket, _, name, _ in rows}
    assert merged(json.dumps(reply)) == same | {("k", "one"): "big", ("k", "two"): "also"}
    assert merged("no idea") == merged("[1]") == merged('{"merged": 3}') == same
    assert categories_module.merge_categories(found.limit(0), lambda: str.upper, 2).collect() == []


def test_chunks_do_not_change_categories(papers):
    def service():
        return lambda prompt: answer_for({t: "c" + t[-1:] for t in re.findall("Title: (.*)", prompt)})

    def run(budget, chunk_ords):
        done = batches.classify_papers(papers, service, ["w"], template=TEMPLATE, budget=budget, chunk_ords=chunk_ords)
        return {row.ord: row.category for row in done.collect()}

    whole = run(10**6, 1000)
    assert whole[32] == "c1" and whole[30] == "Unclassified" and whole[40] == ""
    assert run(100, 1) == run(100, 7) == run(10**6, 3) == whole


def test_sparse_numbers_share_prompts(spark):
    rows = [(number * 1000, "k", f"t{number}", "s") for number in range(100)]
    batched = batches.prompt_batches(spark.createDataFrame(rows, SCHEMA))
    assert [row.papers for row in batches.batch_context(batched).collect()] == [100]


def test_papers_without_a_number_are_packed(spark):
    rows = [(None, "k", f"t{number}", "s" * 10) for number in range(50)]
    batched = batches.prompt_batches(spark.createDataFrame(rows, SCHEMA), budget=100)
    sizes = [(row.papers, len(row.papers_info)) for row in batches.batch_context(batched).collect()]
    assert sum(n for n, _ in sizes) == 50 and all(size <= 200 for _, size in sizes)
