import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators import passages, qa, topics
from paperloom.plans.paper_qa import answer_table, save_answers
from paperloom.sources.files import pdf_listing, read_questions

PAGES = "doc_id string, page_no int, text string"


@pytest.fixture
def pages(spark):
    rows = [("d", 1, "one"), ("d", 2, ""), ("d", 3, "three"), ("d", 4, None), ("e", 1, ""), ("e", 2, "late")]
    rows += [("f", number, f"p{number}") for number in range(1, 8)]
    return spark.createDataFrame(rows, PAGES)


def test_page_text(pages):
    found = {row.doc_id: row.content for row in qa.page_text(pages.repartition(5), 5).collect()}
    assert found["d"] == "--- Page 1 ---\none\n\n--- Page 3 ---\nthree"
    assert found["f"] == "\n\n".join(f"--- Page {number} ---\np{number}" for number in range(1, 6))
    assert {row.doc_id: row.content for row in qa.page_text(pages, 1).collect()}["e"] == ""
    assert "p7" in {row.doc_id: row.content for row in qa.page_text(pages, None).collect()}["f"]


@pytest.mark.parametrize("limit", [1, 2, 5, 100])
def test_page_stats_agree_with_the_text(pages, limit):
    texts = {row.doc_id: row.content for row in qa.page_text(pages, limit).collect()}
    totals = {"d": 4, "e": 2, "f": 7}
    for row in qa.page_stats(pages, limit).collect():
        assert (row.pages_read, row.total_pages) == (min(limit, totals[row.doc_id]), totals[row.doc_id])
        assert row.chars == len(texts[row.doc_id])


def test_questions_file(spark, tmp_path):
    path = tmp_path / "questions.txt"
    path.write_bytes("  What? \r\n\n \t\nList them. \n  Ende".encode())
    assert read_questions(spark, str(path)) == ["What?", "List them.", "Ende"]
    path.write_text(" \n\n")
    with pytest.raises(ValueError):
        read_questions(spark, str(path))


@pytest.mark.parametrize("questions", [[], [""], ["ok", "  "]])
def test_blank_questions_are_refused(pages, questions):
    with pytest.raises(ValueError):
        qa.with_questions(pages, questions)


def test_pairs(pages):
    docs = pages.select("doc_id").distinct()
    found = qa.with_questions(docs, ["q1", "q2"])
    assert found.count() == 6
    assert {(row.q_idx, row.question) for row in found.collect()} == {(1, "q1"), (2, "q2")}


def test_prompt_cuts_the_text(spark):
    contents = spark.createDataFrame([("d", "abcdef"), ("e", "")], "doc_id string, content string")
    found = qa.qa_prompts(contents, ["why {x}?"], "<{pdf_content}|{question}>", limit=3).collect()
    assert [(row.doc_id, row.prompt) for row in found] == [("d", "<abc|why {x}?>")]


def reader():
    def send(prompt):
        if "three" in prompt:
            raise RuntimeError("busy")
        return f"  {len(prompt)} \n"

    return send


def test_answer_table(pages, tmp_path):
    wide = answer_table(pages, ["q1", "q22"], reader, max_pages=1, template="{pdf_content}{question}")
    found = {row.doc_id: tuple(row[1:]) for row in wide.collect()}
    size = len("--- Page 1 ---\none")
    assert wide.columns == ["doc_id", "question_1", "answer_1", "question_2", "answer_2"]
    assert found["d"] == ("q1", str(size + 2), "q22", str(size + 3))
    assert found["e"] == ("q1", qa.NO_TEXT, "q22", qa.NO_TEXT)
    failed = answer_table(pages, ["q"], reader, max_pages=3, template="{pdf_content}{question}")
    assert {row.doc_id: row.answer_1 for row in failed.collect()}["d"] == "API call failed: busy"
    path = save_answers(wide, str(tmp_path), "folder")
    assert re.search(r"/paper_qa_folder_\d{8}_\d{6}\.csv$", path)
    with pytest.raises(ValueError):
        save_answers(wide.where("false"), str(tmp_path))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(1, 6), st.integers(1, 3)), min_size=1))
def test_wide_and_back(spark, cells):
    rows = [(doc, number, f"q{number}", f"a{doc}{number}") for doc, number in cells]
    long = spark.createDataFrame(rows, "doc_id long, q_idx int, question string, answer string")
    back = qa.qa_unpivot(qa.qa_wide(long, 3))
    assert sorted(tuple(row) for row in back.collect()) == sorted(rows)


def test_preview_answers(spark):
    rows = [(doc, 1, "q" * 60, f"a{doc}") for doc in (3, 1, 2)]
    wide = qa.qa_wide(spark.createDataFrame(rows, "doc_id long, q_idx int, question string, answer string"), 2)
    found = sorted(tuple(row) for row in qa.preview_answers(wide).collect())
    assert found == [(1, 1, "q" * 50 + "...", "a1..."), (2, 1, "q" * 50 + "...", "a2...")]


@pytest.mark.parametrize("limit", [0, -1])
def test_page_limit_must_be_positive(pages, limit):
    with pytest.raises(ValueError):
        qa.page_text(pages, limit)


def test_pdf_listing(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", "c.txt", "d.pdf.bak"):
        (tmp_path / name).write_bytes(b"%PDF")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.pdf").write_bytes(b"%PDF")
    found = pdf_listing(spark, str(tmp_path)).orderBy("path").collect()
    assert [(row.pdf_filename, row.length) for row in found] == [("B.PDF", 4), ("a.pdf", 4)]


def brute_bm25(pages, questions, top_k):
    tokens = {(doc, page): re.findall(r"[^\W_]+", text.lower()) for doc, page, text in pages}
    mean = sum(map(len, tokens.values())) / len(tokens)
    found = []
    for number, question in enumerate(questions, 1):
        scores = {}
        for at, words in tokens.items():
            score = 0.0
            for term in dict.fromkeys(re.findall(r"[^\W_]+", question.lower())):
                df = sum(term in other for other in tokens.values())
                tf = words.count(term)
                idf = math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5))
                score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean)) if tf else 0.0
            scores[at] = round(score, 6)
        for doc in {doc for doc, _ in tokens}:
            ranked = sorted(((-score, page) for (d, page), score in scores.items() if d == doc))[:top_k]
            found += [(doc, number, rank, page, -score) for rank, (score, page) in enumerate(ranked, 1)]
    return sorted(found)


def test_passages_against_loops(spark):
    rows = [
        (1, 1, "The cat sat. The CAT ran!"), (1, 2, "a dog_cat, äther"), (1, 3, ""), (2, 1, "dog dog dog cat " * 9),
        (2, 2, "nothing here"), (3, 1, "Äther und Katze"),
    ]
    questions = ["The cat?", "ÄTHER dog äther", "zebra"]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    for parts in (1, 4):
        found = passages.qa_passages(pages.repartition(parts), questions, 2)
        assert sorted(tuple(row) for row in found.collect()) == brute_bm25(rows, questions, 2)


def test_passages_need_words(pages):
    with pytest.raises(ValueError):
        passages.qa_passages(pages, ["?!"])


def test_topics(spark):
    words = ["sun moon star", "bread milk salt"]
    docs = spark.createDataFrame(
        [(number, f"{words[number % 2]} {words[number % 2]} w{number}") for number in range(20)] + [(20, None)],
        "doc_id long, text string",
    )
    found = {row.doc_id: (row.cluster, row.topic) for row in topics.topic_clusters(docs, 2, seed=1).collect()}
    assert len(found) == 21
    sky, food = {found[number] for number in range(0, 20, 2)}, {found[number] for number in range(1, 20, 2)}
    assert len(sky) == len(food) == 1 and sky != food
    assert all(len(topic.split()) == 3 for _, topic in found.values())


def test_topics_do_not_depend_on_partitions(spark):
    rows = [(n, " ".join(f"w{(n * n + i * (n % 3 + 1)) % 37}" for i in range(12)) if n % 11 else None) for n in range(120)]
    rows += [(200, ""), (201, "w1 " * 5000), (7, rows[7][1])]  # without words, very long, a row twice
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(topics.topic_clusters(docs.coalesce(1), 3).collect())
    assert one == sorted(topics.topic_clusters(docs.repartition(5), 3).collect())
    assert len(one) == len(rows) and len({row.cluster for row in one}) == 3
    assert {row.cluster for row in one if row.doc_id in (0, 200)} == {0}


def test_topics_of_little(spark):
    def clusters(*texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return sorted(tuple(row) for row in topics.topic_clusters(docs, 3, rounds=1).collect())

    assert clusters() == []
    assert clusters(None, "?") == [(0, 0, ""), (1, 0, "")]
    # One word in all documents tells them apart no more than none does.
    assert clusters("same", "same") == [(0, 0, "same"), (1, 0, "same")]
    assert [cluster for _, cluster, _ in clusters("a", "a", "b", "c")][:2] in ([0, 0], [1, 1], [2, 2])


def test_every_listed_document_is_answered(spark):
    from paperloom.plans.paper_qa import answer_table

    pages = spark.createDataFrame([("a", 1, "x" * 30), ("b", 7, "late")], "doc_id string, page_no int, text string")
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    wide = answer_table(pages, ["q"], lambda: lambda text: str(len(text)), limit=None, documents=listed)
    found = {row.doc_id: row.answer_1 for row in wide.collect()}
    assert found["b"] == found["c"] == qa.NO_TEXT and found["a"] != qa.NO_TEXT
    assert {row.doc_id for row in answer_table(pages, ["q"], lambda: lambda text: str(len(text))).collect()} == {"a", "b"}


def test_text_limit_reaches_the_pages(spark):
    rows = [("a", 1, "x" * 50), ("a", 2, ""), ("a", 3, "y" * 400), ("b", 1, "é" * 5), ("c", 1, None)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    for limit in (1, 15, 64, 66, 80, 81, 1000):
        cut = dict(qa.page_text(pages, limit=limit).collect())
        assert cut == {doc: content[:limit] for doc, content in qa.page_text(pages).collect()}


def test_answers_for_a_folder(spark, tmp_path):
    from paperloom.plans.paper_qa import answer_folder, save_answers

    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    pages = spark.createDataFrame([("a.pdf", 1, "text"), ("z.pdf", 1, "gone")], "doc_id string, page_no int, text string")
    wide = answer_folder(spark, str(tmp_path), pages, ["q"], lambda: lambda text: "told")
    assert {row.doc_id: row.answer_1 for row in wide.collect()} == {"a.pdf": "told", "b.pdf": qa.NO_TEXT}
    path = save_answers(wide, str(tmp_path / "out"), "set")
    assert re.fullmatch(r"paper_qa_set_\d{8}_\d{6}\.csv", path.rsplit("/", 1)[1])
    with pytest.raises(ValueError):
        answer_folder(spark, str(tmp_path / "out"), pages, ["q"], lambda: lambda text: "told")
