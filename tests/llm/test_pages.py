"""Main texts of the test pages, stray text, odd tables and pages that nest without end."""

from __future__ import annotations

import html
import re
import time
from pathlib import Path

import pytest

from folioscope.llm import html_text

PAGES = Path("/root/testdata/sf0.01/pages.parquet")


def article(source: str) -> str:
    """What the article element of a test page holds, read in a plain way: blocks at p, headings and their ends."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", source, re.S)[1]
    inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inner, flags=re.S)
    inner = re.sub(r"<(div|aside|form|nav|section)\b.*?</\1>", "\0", inner, flags=re.S)
    parts = re.split(r"</?(?:p|h[1-6]|li|ul|ol|blockquote|table|tr|td|header|pre)\b[^>]*>|\0", inner)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
    return "\n".join(x for x in lines if x)


@pytest.mark.skipif(not PAGES.exists(), reason="no test tables")
def test_articles_of_all_test_pages(spark):
    rows = html_text.extract(spark.read.parquet(str(PAGES)), html_text.train(), keep=("url", "html")).collect()
    assert len(rows) >= 250 and [r["page_id"] for r in rows if r["text"] != article(r["html"])] == []


@pytest.mark.parametrize("tag", ["a", "p", "span"])
def test_stray_text_of_a_page_goes(tag):
    body = "<article><h1>Title of it</h1>" + "<p>The river ran by the house, and the stone was light. It was so.</p>" * 4 + "</article>"
    page = f'<html><body><a href="#main">Skip to content</a><nav><ul><li><a href=/a>Menu</a></ul></nav>{body}<footer>&copy; me</footer></body></html>'
    assert html_text.main_texts(html_text.train(), [page])[0].split("\n")[0] == "Title of it"
    bare = "<h1>On rivers</h1>The river ran by the house, and the stone was light.<br>It was so, and it went on for long, as rivers do."
    assert "The river ran" in html_text.main_texts(html_text.train(), [bare])[0]


def test_empty_repeated_and_clashing(spark):
    model = html_text.train()
    table = spark.createDataFrame([(1, "u", "<p>Some words of a text.</p>", "x", 5)] * 3 + [(None, None, None, "x", 5)], "page_id long, url string, html string, text string, n_chars int")
    rows = html_text.extract(table, model).collect()
    assert len(rows) == 4 and len({tuple(r) for r in rows}) == 2
    assert html_text.extract(table.limit(0), model).count() == 0
    assert {r["keep"] for r in html_text.extract(table.withColumnRenamed("text", "keep"), model, keep=("keep",)).collect()} == {"x"}


NESTS = {
    "ends without starts": lambda n: "<b>" * n + "</i>" * n,
    "one start far out": lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
    "open quotes": lambda n: '<p a="' * n,
    "open quotes and an end": lambda n: '<p a="' * n + ">x",
    "open tags": lambda n: "<p " * n,
    "svg": lambda n: '<svg a="</svg>' * n,
    "boxes": lambda n: "<div>" * n + "deep",
    "notes": lambda n: "<!-- " * n,
    "items": lambda n: "<ul><li>" * n + "</ul>" * n,
    "rows": lambda n: "<table><tr><td>" * n + "</td>" * n,
    "raw": lambda n: "<script>" * n + "<style" * n,
}


@pytest.mark.parametrize("name", list(NESTS))
def test_time_is_in_proportion(name):
    model = html_text.train()

    def took(n: int) -> float:
        source = NESTS[name](n)
        began = time.perf_counter()
        html_text.main_texts(model, [source])
        return time.perf_counter() - began

    took(100)
    assert took(40_000) < 24 * max(took(5000), 0.1)


def test_torn_tags():
    assert html_text.parse('<p>a</p><p title="b>c</p><p>d</p>').texts == ["a", "c", "d"]
    assert html_text.parse('<p title="x > y">c</p>').texts == ["c"]
    assert html_text.parse("<p>c <b").texts == ["c"]
