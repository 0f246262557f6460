"""HTML extraction against a plain reading of the article, and in time that grows with the page."""

import html
import re
import time

import duckdb
import pytest
from codeloom.llm import html_extract

LINE = "A paragraph of some length, with commas, that is the main text."


def test_whole_table_against_a_plain_reading():
    """The pages' own main part is one article element, so its text can be cut out by patterns alone."""
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (page,) in rows:
        page = page or ""
        inner = re.search(r"<article[^>]*>(.*?)(?:</article>|<footer|\Z)", re.sub(r"(?s)<!--.*?-->", "", page), re.S)
        inner = re.sub(r"(?s)<(script|style|aside|form|nav)\b.*?</\1>|<(\w+) (?:class|id)=\"(?:comments?|ad|share|related|newsletter|cookie)\".*?</\2>", "\n\n", inner[1])
        lines = re.split(r"(?i)</?(?:p|h[1-6]|div|ul|ol|li|blockquote|section|figure|figcaption|pre|table|tr|td|th|tbody|dl|dt|dd|hr)\b[^>]*>|\n\n", inner)
        want = [x for x in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<br\s*/?>", " ", x) and re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x)))).strip() for x in lines) if x]
        assert html_extract.main_blocks(page) == want, page


def test_headlines_and_parts_beside_the_article():
    body = f"<p>{LINE}</p>" * 2
    assert html_extract.main_blocks(f'<article><div class="entry-header"><h1>Title</h1><p class="x">By someone</p></div>{body}</article>') == ["Title", LINE, LINE]
    assert html_extract.main_blocks(f"<article><header><h1>Title</h1><nav><h2>No</h2></nav></header>{body}</article>") == ["Title", LINE, LINE]
    assert html_extract.main_blocks(f"<header><h1>Site</h1></header><article>{body}</article>") == [LINE, LINE]
    assert html_extract.main_blocks(f"<div><article>{body}</article><div>{body * 3}</div><div class=ad>{body}</div><div><a href=x>{LINE}</a></div></div>") == [LINE] * 8
    assert html_extract.main_blocks(f"<article>{body}<p>a &lt;b&gt; <a title='x>y'>link</a> end of a line</p></article>")[-1] == "a <b> link end of a line"
    assert html_extract.main_blocks("<" * 2000) == ["<" * 2000] and html_extract.main_blocks("a < b, and c > d, and so on, at length") == ["a < b, and c > d, and so on, at length"]


ODD = {
    "unclosed tags": lambda n: "<a " * n, "nested text": lambda n: "<div>x long enough text, with a comma in it " * n, "inline": lambda n: "<b>" * n + "<p>some text, of a length" * n, "stray ends": lambda n: "<div>" * n + "</i>" * n,
    "cells": lambda n: "<td><i>" + "<u>" * n + "</b>" * n, "lists": lambda n: "<li>" + "<div>" * n + "<li>" * n, "scripts": lambda n: "<script>" + "</script " * n, "quotes": lambda n: '<a ">" ' * n + '"', "blocks in inline": lambda n: "<b>" * n + "<div></div>" * n, "comments": lambda n: "<!-- " * n,
}


@pytest.mark.parametrize("name", ODD)
def test_time_grows_with_the_page(name):
    def took(n):
        began = time.process_time()
        html_extract.main_blocks(ODD[name](n))
        return time.process_time() - began

    took(100)
    assert took(40_000) <= 30 * took(4_000) + 0.3 and took(40_000) < 5
