import re
import urllib.parse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.functions import urls as U
from paperloom.functions.languages import language_name



@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://arxiv.org/abs/2401.1", True),
        ("https://arxiv.org/pdf/2401.1", True),
        ("https://arxiv.org/list/2401.1", False),
        ("https://ARXIV.org/abs/2401.1", False),
        ("https://host/abs/1", False),
        ("", False),
        (None, False),
    ],
)
def test_is_arxiv(one, url, expected):
    assert one(U.is_arxiv(F.col("u")), u=url) is expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://arxiv.org/abs/1.2", "https://arxiv.org/pdf/1.2.pdf"),
        ("https://arxiv.org/abs/1.2.pdf", "https://arxiv.org/pdf/1.2.pdf.pdf"),
        ("https://arxiv.org/abs/x/abs/y", "https://arxiv.org/pdf/x/pdf/y.pdf"),
        ("https://arxiv.org/pdf/1.2", "https://arxiv.org/pdf/1.2.pdf"),
        ("https://arxiv.org/pdf/1.2.pdf", "https://arxiv.org/pdf/1.2.pdf"),
        ("https://arxiv.org/list/1.2", "https://arxiv.org/list/1.2"),
        ("https://host/abs/1.2", "https://host/abs/1.2"),
        ("", ""),
        (None, None),
    ],
)
def test_pdf_url(one, url, expected):
    assert one(U.pdf_url(F.col("u")), u=url) == expected


@pytest.mark.parametrize(
    "url, title, expected",
    [
        ("https://arxiv.org/pdf/1.2", "T", "1.2.pdf"),
        ("https://arxiv.org/pdf/1.2.pdf", "T", "1.2.pdf"),
        ("https://arxiv.org/pdf/a/pdf/b.pdf.pdf", "T", "b.pdf"),
        ("https://arxiv.org/abs/1.2", "A: b/c d! ", "A_bc_d.pdf"),
        ("https://arxiv.org/abs/1.2", "é中-_ 1²", "é中-__1².pdf"),
        ("https://arxiv.org/abs/1.2", "!?*", ".pdf"),
        ("https://arxiv.org/abs/1.2", "", "paper.pdf"),
        ("https://arxiv.org/abs/1.2", None, "paper.pdf"),
        ("https://arxiv.org/abs/1.2", "x" * 80, "x" * 50 + ".pdf"),
    ],
)
def test_pdf_filename(one, url, title, expected):
    assert one(U.pdf_filename(F.col("u"), F.col("t")), u=url, t=title) == expected


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=70).filter(lambda s: "\x00" not in s and not any("\ud800" <= c <= "\udfff" for c in s)))
def test_safe_title_any_text(one, title):
    kept = "".join(c for c in title if c.isalnum() or c in " -_")
    # Characters newer than the JVM's tables may differ; none of the common ones do.
    if re.search(r"[^\u0000-⿿]", title) is None:
        assert one(X.safe_title(F.col("t")), t=title) == kept.rstrip(" ").replace(" ", "_")[:50]


@pytest.mark.parametrize(
    "href, expected",
    [
        ("/p/1", "https://s.example/p/1"),
        ("http://a/b", "http://a/b"),
        ("https://a/b", "https://a/b"),
        ("httpx", "httpx"),
        ("", ""),
        (None, ""),
    ],
)
def test_absolute_url(one, href, expected):
    assert one(U.absolute_url(F.col("u"), "https://s.example"), u=href) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://h/papers/2504.17550", "2504.17550"),
        ("https://h/papers/2504.17550v2?x", "2504.17550"),
        ("https://h/papers/abc", ""),
        ("https://h/papers/25/1.2", ""),
        (None, ""),
    ],
)
def test_arxiv_id(one, url, expected):
    assert one(U.arxiv_id(F.col("u")), u=url) == expected


@pytest.mark.parametrize("words", [["llm", "Hallucination"], ["a b", "ü&~*"], ["x"]])
def test_search_url(one, words):
    found = one(U.search_url(F.array(*[F.lit(word) for word in words]), "https://s"))
    assert found == "https://s?q=" + urllib.parse.quote_plus("+".join(words))


def test_paths_and_names(one):
    words = F.array(F.lit("deep net"), F.lit("x"))
    assert one(U.pdf_path(words, F.lit("f.pdf"))) == "pdfs/deep_net_x/f.pdf"
    assert one(U.papers_file_name(U.split_words(F.lit("  llm \t hall ")))) == "papers_llm_hall.csv"
    assert one(U.translated_file_name(F.lit("in"), F.lit("zh-cn"))) == "in_translated_zh_cn.csv"
    assert one(U.classified_file_name(F.lit("in"))) == "in_classified.csv"
    stamp = F.lit("2025-01-02 03:04:05").cast("timestamp")
    assert one(U.qa_file_name(F.lit("f"), stamp)) == "paper_qa_f_20250102_030405.csv"
    assert one(U.qa_file_name(F.lit(""), stamp)) == "paper_qa_results_20250102_030405.csv"


@pytest.mark.parametrize(
    "text", ["  a b\n", "  x　", "\x1c\x1fy\x85", "\n\t ", "", "z\r\n\r\n", "a\n b"]
)
def test_strip_and_blank(one, text):
    assert one(X.strip(F.col("t")), t=text) == text.strip()
    assert one(X.is_blank(F.col("t")), t=text) is (text.strip() == "")


def test_null_is_blank(one):
    assert one(X.is_blank(F.col("t")), t=None) is True
    assert one(X.not_blank(F.col("t")), t=None) is False


def test_cutting(one):
    t = F.col("t")
    assert one(X.shorten(t, 3), t="abc") == "abc"
    assert one(X.shorten(t, 3), t="abcd") == "abc..."
    assert one(X.label(t, 3), t="ab") == "ab..."
    assert one(X.truncate(t, 2), t="𝒳yz") == "𝒳y"
    assert one(X.truncate(t, None), t="xyz") == "xyz"


def test_template_is_filled_once(one):
    filled = X.fill_template("{{x}} {a}-{b}-{a}", a=F.lit("{b}"), b=F.lit(3))
    assert one(filled) == "{x} {b}-3-{b}"
    assert one(X.fill_template("[{a}]", a=F.lit(None))) == "[]"
    with pytest.raises(KeyError):
        X.fill_template("{missing}", a=F.lit(1))


@pytest.mark.parametrize("code, name", [("zh-cn", "Chinese (Simplified)"), ("fi", "Finnish"), ("xx-y", "XX-Y"), (None, None)])
def test_language_name(one, code, name):
    assert one(language_name(F.col("c")), c=code) == name
