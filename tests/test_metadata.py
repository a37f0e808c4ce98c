import pytest
from pyspark.sql import functions as F

from paperloom.operators import metadata, pdfs

CATALOG = "title string, year int, citation_count long"


@pytest.fixture
def papers(spark):
    rows = [(1, "a"), (2, "b"), (3, "c"), (4, "none"), (5, None), (6, "a"), (7, "no year")]
    return spark.createDataFrame(rows, "ord long, title string")


def test_waterfall(spark, papers):
    catalogs = {
        "openalex": spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("no year", 4, 4)], CATALOG),
        "semantic_scholar": spark.createDataFrame([("a", 2001, 9), ("no year", None, 5), (None, 1, 1)], CATALOG),
        "crossref": spark.createDataFrame([("a", 1991, 0), ("b", 1992, 0)], CATALOG),
    }
    found = metadata.metadata_waterfall(papers, catalogs)
    rows = {row.ord: (row.Year, row.Citation_Count, row.Metadata_Source) for row in found.collect()}
    assert rows == {
        1: (2001, 9, "semantic_scholar"), 2: (1992, 0, "crossref"), 3: (3, 3, "openalex"),
        4: (None, 0, "not_found"), 5: (None, 0, "not_found"), 6: (2001, 9, "semantic_scholar"),
        7: (None, 5, "semantic_scholar"),
    }
    assert tuple(metadata.metadata_summary(found).first()) == (5, 7, (9 + 3 + 9 + 5) / 4)


def test_first_hit_of_a_source(spark):
    rows = [("a", 2002, 1, 7), ("a", 2001, 2, 3), ("a", 2003, 3, 9)]
    catalog = spark.createDataFrame(rows, CATALOG + ", rank long").repartition(3)
    row = metadata.first_source({"crossref": catalog}).first()
    assert tuple(row.metadata) == (2001, 2, "crossref")


def test_summary_without_counts(papers):
    empty = papers.select(
        F.lit(None).cast("int").alias("Year"), F.lit(0).alias("Citation_Count"), F.lit("not_found").alias("Metadata_Source")
    )
    assert tuple(metadata.metadata_summary(empty).first()) == (0, 7, None)


def test_failed_calls_are_recorded(papers):
    def failing():
        def send(title):
            raise RuntimeError("limit " + title)

        return send

    def knows_a():
        return lambda title: '{"results":[{"publication_year":2002,"cited_by_count":4}]}' if title == "a" else "{}"

    resolved = metadata.metadata_from_services(papers, {"crossref": failing, "openalex": knows_a})
    rows = {row.ord: tuple(row)[2:] for row in metadata.with_metadata(papers, resolved).collect()}
    assert rows[1] == (2002, 4, "openalex", "crossref: limit a")
    assert rows[2] == (None, 0, "not_found", "crossref: limit b")
    assert rows[5] == (None, 0, "not_found", None)
    assert metadata.metadata_from_services(papers, {}).count() == 0


def test_services_in_turn(papers, tmp_path):
    folder = str(tmp_path)

    def asked(source, reply):
        def service():
            import pathlib
            import uuid

            def send(title):
                pathlib.Path(folder, uuid.uuid4().hex).write_text(f"{source}:{title}")
                return reply(title)

            return send

        return service

    def fail(title):
        raise RuntimeError(title)

    services = {
        "semantic_scholar": asked("s", lambda t: '{"data":[{"year":2000}]}' if t == "a" else '{"data":[]}'),
        "crossref": asked("c", fail),
        "openalex": asked("o", lambda t: '{"results":[{"publication_year":2002,"cited_by_count":4}]}' if t == "b" else "{}"),
    }
    found = metadata.with_metadata(papers, metadata.metadata_from_services(papers, services))
    rows = {row.ord: (row.Year, row.Citation_Count, row.Metadata_Source) for row in found.collect()}
    assert rows[1] == rows[6] == (2000, 0, "semantic_scholar")
    assert rows[2] == (2002, 4, "openalex")
    assert rows[3] == rows[5] == (None, 0, "not_found")
    rest = ["b", "c", "no year", "none"]
    expected = [f"s:{title}" for title in ["a", *rest]] + [f"{source}:{title}" for source in "co" for title in rest]
    assert sorted(file.read_text() for file in tmp_path.iterdir()) == sorted(expected)


def test_pdf_plan(spark):
    rows = [
        (1, "T one", "https://arxiv.org/pdf/1.1"),
        (2, "T two", "https://arxiv.org/abs/2.2"),
        (3, "T two", "https://arxiv.org/abs/3.3"),
        (4, "x", "https://host/pdf/4"),
        (5, None, None),
        (6, "again", "https://arxiv.org/pdf/1.1"),
        (7, None, "https://arxiv.org/abs/7.7"),
    ]
    papers = spark.createDataFrame(rows, "ord long, title string, pdf_url string")
    manifest = spark.createDataFrame([("pdfs/a_b/1.1.pdf",), ("pdfs/a_b/unused.pdf",)], "pdf_path string")
    plan = pdfs.pdf_plan(papers, ["a", "b"], manifest)
    found = {row.ord: (row.pdf_path, row.pdf_status, row.pdf_conflict) for row in plan.collect()}
    assert found == {
        1: ("pdfs/a_b/1.1.pdf", "reuse", False),
        2: ("pdfs/a_b/T_two.pdf", "fetch", True),
        3: ("pdfs/a_b/T_two.pdf", "fetch", True),
        4: (None, "no_arxiv", False),
        5: (None, "no_arxiv", False),
        6: ("pdfs/a_b/1.1.pdf", "reuse", False),
        7: ("pdfs/a_b/paper.pdf", "fetch", False),
    }
    assert tuple(pdfs.pdf_summary(plan).first()) == (5, 3, 2, 7)
    targets = pdfs.target_paths(papers, ["a", "b"])
    assert {tuple(row) for row in pdfs.pdf_todo(targets, manifest).collect()} == {
        ("pdfs/a_b/T_two.pdf", "https://arxiv.org/pdf/2.2.pdf"), ("pdfs/a_b/paper.pdf", "https://arxiv.org/pdf/7.7.pdf")
    }
    assert [tuple(row) for row in pdfs.pdf_reused(targets, manifest).collect()] == [("pdfs/a_b/1.1.pdf", 2)]
