import pytest
from pyspark.sql import functions as F

from paperloom.operators import records
from paperloom.operators.records import PaperRules
from paperloom.operators.select import Rule
from paperloom.plans.crawl import CrawlOptions, paper_table

PAGE = """<html><h1 data-testid="paper-title">A <b>title</b></h1>
<p class="text-blue-700 dark:text-blue-400">Sum</p><p class="text-gray-600">Abs &amp; more</p>
<a class="btn inline-flex h-9 items-center" href="{href}">PDF</a></html>"""
BLOCK = (
    '<div class="flex w-full gap-6"><h3 class="mb-3 text-lg/6 font-semibold hover:underline '
    'peer-hover:underline 2xl:text-[1.2rem]/6"><a class="line-clamp-3 cursor-pointer text-balance"{href}>t</a></h3></div>'
)


def block(href):
    return BLOCK.format(href=f' href="{href}"' if href is not None else "")


@pytest.fixture
def pages(spark):
    rows = [
        (1, "https://huggingface.co/papers/2401.00001", PAGE.format(href="https://arxiv.org/pdf/2401.00001")),
        (2, "https://huggingface.co/papers/2401.00002", PAGE.format(href="/files/2")),
        (3, "https://huggingface.co/papers/none", "<p>nothing here"),
        (4, "https://huggingface.co/papers/2401.00004", None),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_paper_records(pages):
    found = {row.page_id: row for row in records.paper_records(pages).collect()}
    assert found[1][2:] == ("Atitle", "Sum", "Abs & more", "https://arxiv.org/pdf/2401.00001", "2401.00001", None)
    assert found[2].pdf_url == "https://huggingface.co/files/2"
    assert found[3][2:] == ("", "", "", "", "", None)
    assert found[4].url and found[4].title is None and found[4].error == "no page content"


def test_export_drops_errors_and_fills(pages):
    exported = records.export_papers(records.paper_records(pages))
    assert exported.columns == ["title", "llm_summary", "abstract", "pdf_url", "arxiv_id", "url"]
    assert exported.count() == 3


def listing(spark):
    rows = [
        ("s", 2, block("/papers/2401.00009")),
        ("s", 1, block("/papers/2401.00001") + block(None) + block("") + block("/papers/2401.00002") + "<div>x</div>"),
        ("s", 3, block("/papers/2401.00001")),
        ("t", 1, "<div class='gap-6 flex w-full'><h3><a href='/no'>n</a></h3></div>"),
        ("u", 1, None),
    ]
    return spark.createDataFrame(rows, "search_id string, page_ord long, html string")


@pytest.mark.parametrize("n, expected", [(2, [1, 2]), (10, [1, 2, 9, 1])])
def test_listing_links(spark, n, expected):
    links = records.listing_links(listing(spark), n).orderBy("search_id", "ord").collect()
    assert [row.url for row in links] == [f"https://huggingface.co/papers/2401.0000{number}" for number in expected]
    assert [row.ord for row in links] == list(range(1, len(expected) + 1))


def test_links_are_numbered_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(records, "CHUNK_PAGES", 3)
    rows = [("s", at, block(f"/{at}-1") + block(f"/{at}-2"), 7) for at in (None, 0, 1, 2, 5, 700)]
    rows += [(None, 4, block("/none"), 1), ("t", 1, block("/t"), None), ("u", 1, block("/u"), 0)]
    pages = spark.createDataFrame(rows, "search_id string, page_ord long, html string, n int").repartition(4)
    found = records.listing_links(pages, F.col("n"), site="").collect()
    assert sorted((row.search_id or "", row.ord, row.url[-4:]) for row in found) == [("", 1, "none")] + [
        ("s", place + 1, f"/{at}-{number}"[-4:])
        for place, (at, number) in enumerate([(None, 1), (None, 2), (0, 1), (0, 2), (1, 1), (1, 2), (2, 1)])
    ]
    assert records.listing_links(pages, 5000, site="").count() == 15


def test_records_for_links(spark, pages):
    doubled = pages.unionByName(pages.where("page_id = 1").withColumn("page_id", F.lit(99).cast("long")))
    changed = doubled.withColumn("html", F.when(F.col("page_id") == 99, "<h1>later</h1>").otherwise(F.col("html")))
    links = records.listing_links(listing(spark), 10)
    found = records.records_for_links(links, changed).orderBy("ord").collect()
    assert [(row.ord, row.title, row.error) for row in found] == [
        (1, "Atitle", None), (2, "Atitle", None), (3, None, "page not found"), (4, "Atitle", None)
    ]


def test_whole_run(spark, pages):
    def shout():
        return lambda text: f'[[["{text.upper()}"]]]'

    def group():
        return lambda prompt: '{"categories": {"c": "d"}, "classifications": {"Atitle": "c"}}'

    catalog = spark.createDataFrame([("Atitle", 2020, 7)], "title string, year int, citation_count long")
    manifest = spark.createDataFrame([("pdfs/a/2401.00001.pdf",)], "pdf_path string")
    options = CrawlOptions(
        n=10, words=["a"], manifest=manifest, translate=shout, catalogs={"openalex": catalog}, classify=group
    )
    found = {row.ord: row for row in paper_table(listing(spark), pages, options).collect()}
    assert len(found) == 4
    assert (found[1].pdf_status, found[2].pdf_status, found[1].pdf_path) == ("reuse", "no_arxiv", "pdfs/a/2401.00001.pdf")
    assert found[1].abstract_translate == "ABS & MORE"
    assert (found[1].Year, found[1].Citation_Count, found[1].Metadata_Source) == (2020, 7, "openalex")
    assert (found[3].error, found[3].Metadata_Source, found[3].category) == ("page not found", "not_found", "Unclassified")
    assert found[1].category == "c"


def test_small_operators(spark):
    papers = spark.createDataFrame(
        [(1, "a", "u1", None), (2, None, "u2", "404"), (3, "c", None, None)],
        "ord long, title string, url string, error string",
    )
    assert records.without_errors(papers).count() == 2
    assert records.run_counts(papers).first() == (3, 2, 1)
    assert sorted(records.basic_columns(papers).collect()) == [("", "u2"), ("a", "u1"), ("c", "")]
    assert records.basic_columns(papers.select("ord", "title", "error")).columns == ["ord", "title"]
    assert [tuple(row) for row in records.clean_nulls(papers).where("ord = '2'").collect()] == [("2", "", "u2", "404")]
    united = records.union_records(papers.drop("error"), papers.select("ord", "error"))
    assert united.columns == ["ord", "title", "url", "error"] and united.count() == 6


def test_preview(spark):
    papers = spark.createDataFrame(
        [(2, "t2", "abc", None), (1, "t" * 60, "a" * 70, "x" * 61), (3, "t3", None, None)],
        "ord long, title string, abstract string, abstract_translate string",
    )
    assert [tuple(row) for row in records.preview(papers).collect()] == [
        (1, "t" * 50 + "...", "x" * 60 + "..."), (2, "t2...", "abc...")
    ]


def test_other_rules(spark):
    pages = spark.createDataFrame([(1, "u", "<i>T</i><b>S</b><u>A</u><a>x</a>")], "page_id long, url string, html string")
    rules = PaperRules(title=(Rule("i"),), summary=Rule("b"), abstract=Rule("u"), pdf=Rule("a"))
    row = records.paper_records(pages, rules=rules).first()
    assert row[2:] == ("T", "S", "A", "", "", None)


def test_preview_shows_what_is_there(spark):
    papers = spark.createDataFrame(
        [(1, "t", "a", "c", 2020, 0, "p"), (2, "u", "b", None, None, 3, None)],
        "ord long, title string, abstract string, category string, Year int, Citation_Count long, pdf_path string",
    )
    assert [tuple(row) for row in records.preview(papers).collect()] == [
        (1, "t...", "a...", "c", 2020, None, "p"), (2, "u...", "b...", None, None, 3, None)
    ]


def test_save_papers_by_words(spark, tmp_path):
    from paperloom.plans.crawl import save_papers

    papers = spark.createDataFrame([(1, "t", None), (2, None, "page not found")], "ord int, title string, error string")
    path = save_papers(papers, str(tmp_path), ["graph", "nets"])
    assert path.endswith("/papers_graph_nets.csv")
    found = spark.read.csv(path, header=True).orderBy("ord").collect()
    assert [tuple(row) for row in found] == [("1", "t", None), ("2", None, "page not found")]
    with pytest.raises(ValueError):
        save_papers(papers, str(tmp_path), [])


def test_fill_selected(spark):
    papers = spark.createDataFrame([(None, None)], "abstract string, title string")
    assert records.fill_selected(papers).first() == ("", None)
