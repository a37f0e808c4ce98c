import pytest
from pyspark.sql import functions as F

from paperloom.operators.records import PDF_RULE, SUMMARY_RULE, TITLE_RULES
from paperloom.operators.select import Rule, attribute, find, find_all, find_by_priority, find_nested, text_of
from paperloom.sources.html import node_rows, page_nodes, parse_html


@pytest.fixture
def nodes(spark):
    def parsed(html, rules=None):
        return parse_html(spark.createDataFrame([(1, html)], "page_id long, html string"), rules)

    return parsed


def text(frame, rule, sep=""):
    found = frame.select("nodes", find(F.col("nodes"), rule).alias("e"))
    return found.select(text_of(F.col("nodes"), F.col("e"), sep).alias("t")).first().t


@pytest.mark.parametrize(
    "html, tag, expected",
    [
        ("<h1>A <b>B</b></h1>", "h1", "AB"),
        ("<h1> A <!-- c --> B </h1>", "h1", "AB"),
        ("<h1>A &amp; B &lt;C&gt; &#233;&#x41;</h1>", "h1", "A & B <C> éA"),
        ("<h1>AT&T &nosuch; x</h1>", "h1", "AT&T &nosuch x"),
        ("<p>one<p>two</p>three", "p", "onetwothree"),
        ("<div><p>one<div>two</p>three</div>four</div>", "div", "onetwothree"),
        ("<p>a<br>b<br/>c</p>d", "p", "abc"),
        ("<p>a</b>b</p>c", "p", "ab"),
        ("<p>a<script>var x='</p>';</script>b</p>", "p", "ab"),
        ("<script>go()</script>", "script", "go()"),
        ("<p>a<template><i>no</i></template>b</p>", "p", "ab"),
        ("<div><p>a", "div", "a"),
        ("<h1></h1>", "h1", ""),
        ("<h1>  x  </h1>", "h1", "x"),
        ("<span/>x", "span", ""),
    ],
)
def test_text(nodes, html, tag, expected):
    assert text(nodes(html), Rule(tag)) == expected
    assert text(nodes(html, [Rule(tag)]), Rule(tag)) == expected


def test_text_with_separator(nodes):
    assert text(nodes("<h1>A <b>B</b></h1>"), Rule("h1"), " ") == "A B"


def test_positions():
    found = page_nodes("<div><p>a<p>b</p></p><br></div>x")
    spans = [(node.get("tag") or node["text"], node["pos"], node["end_pos"]) for node in found]
    assert spans == [("div", 0, 5), ("p", 1, 4), ("a", 2, 2), ("p", 3, 4), ("b", 4, 4), ("br", 5, 5), ("x", 6, 6)]


def test_kept_nodes_are_numbered_anew():
    found = page_nodes("<div><p>a</p><h1 class='t'>b<i>c</i></h1></div>", [Rule("h1")])
    assert [(node.get("tag") or node["text"], node["pos"], node["end_pos"]) for node in found] == [
        ("h1", 0, 2), ("b", 1, 1), ("c", 2, 2)
    ]


def test_attributes_and_classes(nodes):
    frame = nodes("""<a CLASS=" x  y " href='/1?a&amp;b' disabled href="/2">t</a>""")
    row = node_rows(frame, "page_id").first()
    assert (row.tag, row.class_attr, row.classes) == ("a", "x y", ["x", "y"])
    assert row.attrs == {"class": " x  y ", "href": "/2", "disabled": ""}


@pytest.mark.parametrize(
    "rule, count",
    [
        (Rule("p", class_attr="a b"), 2),
        (Rule("p", classes=("b", "a")), 4),
        (Rule("p"), 5),
        (Rule(classes=("a",)), 5),
        (Rule(attrs={"data-testid": "t"}), 1),
        (Rule("p", attrs={"data-testid": "t"}), 0),
        (Rule("p", class_attr="a"), 0),
    ],
)
def test_rules(nodes, rule, count):
    html = (
        "<p class='a b'></p><p class='b a'></p><p class='a  b'></p><p class='a b c'></p><p></p>"
        "<i class='a' data-testid='t'></i>"
    )
    for frame in (nodes(html), nodes(html, [rule])):
        assert frame.select(F.size(find_all(F.col("nodes"), rule)).alias("n")).first().n == count


@pytest.mark.parametrize(
    "html, title",
    [
        ("<h1>c</h1><h1 class='title'>b</h1><h1 data-testid='paper-title'>a</h1>", "a"),
        ("<h1>c</h1><h1 class='x title'>b</h1>", "b"),
        ("<h1>c</h1><i class='paper-title'>d</i>", "c"),
        ("<i data-testid='paper-title'>e</i><i class='paper-title'>d</i>", "d"),
        ("<h1 class='title'></h1><h1>c</h1>", ""),
        ("<p>x</p>", ""),
    ],
)
def test_title_priority(nodes, html, title):
    frame = nodes(html, TITLE_RULES).select("nodes", find_by_priority(F.col("nodes"), TITLE_RULES).alias("e"))
    assert frame.select(text_of(F.col("nodes"), F.col("e")).alias("t")).first().t == title


def test_fixed_rules(nodes):
    html = (
        "<p class='text-blue-700 dark:text-blue-400 more'>S</p>"
        "<a class='btn inline-flex h-9 items-center' href='/x'>pdf</a>"
    )
    frame = nodes(html, [SUMMARY_RULE, PDF_RULE])
    assert text(frame, SUMMARY_RULE) == "S"
    assert frame.select(attribute(find(F.col("nodes"), PDF_RULE), "href").alias("h")).first().h == "/x"


def test_nested_blocks(nodes):
    html = (
        "<div class='r'>1<div class='r'><h3><a href='/in'>i</a></h3></div></div>"
        "<div class='r'><a href='/no'>n</a></div>"
        "<div class='r'><h3>x</h3><h3><a href='/second'>s</a></h3></div>"
    )
    steps = [Rule("h3"), Rule("a")]
    frame = nodes(html, [Rule("div", class_attr="r"), *steps])
    links = find_nested(F.col("nodes"), Rule("div", class_attr="r"), steps)
    hrefs = F.transform(links, lambda element: attribute(element, "href"))
    # The outer block finds the link of the inner one; in the last block only the first h3 counts.
    assert frame.select(hrefs.alias("h")).first().h == ["/in", "/in"]


def test_null_page_keeps_its_row(nodes):
    assert nodes(None).first().nodes is None
    assert nodes("").first().nodes == []


def test_many_pages_any_partitioning(spark):
    rows = [(number, f"<h1>t{number}</h1><p>x</p>") for number in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    for parts in (1, 8):
        frame = parse_html(pages.repartition(parts), [Rule("h1")])
        found = {row.page_id: row.nodes[1].text for row in frame.collect()}
        assert found == {number: f"t{number}" for number in range(300)}


def test_broken_page_keeps_its_row(nodes):
    row = nodes("<h1>a</h1><![bad[x]]>").first()
    assert row.nodes is None and row.parse_error.startswith("unreadable page: ")


def test_deep_nesting_is_linear():
    found = page_nodes("<p>x" * 20000 + "</i>" * 20000 + "</p>" * 20000)
    assert len(found) == 40000 and found[0]["end_pos"] == 39999


def test_without_texts():
    found = page_nodes("<div>a<p class='x y'>b</p></div>", texts=False)
    assert [(node["tag"], node["pos"], node["end_pos"]) for node in found] == [("div", 0, 1), ("p", 1, 1)]


def test_void_tags_and_their_end_tags_take_linear_time():
    import time

    from paperloom.sources.html import page_nodes

    def seconds(n):
        started = time.perf_counter()
        page_nodes("<br>" * n + "</p></i>" * n)
        return time.perf_counter() - started

    seconds(1000)
    assert seconds(50_000) < 5 * seconds(25_000)
