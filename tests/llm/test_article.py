"""Main text of pages against the pages' own markup, and on hand-made ones."""

from __future__ import annotations

import html
import re
from pathlib import Path

import pytest

from tidemark.llm import article, common, queries

SF = "/root/testdata/sf0.01"
PROSE = "A sentence of the article, with commas, and enough words to read like prose."


def plain(page):
    """The test pages have one article of headings and paragraphs."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_query_against_the_markup(spark):
    want = {r["page_id"]: (r["url"], plain(r["html"])) for r in common.load(spark, SF, "pages").collect()}
    got = queries.op13_main_text(spark, SF).collect()
    assert len(got) == len(want) and all((r["url"], r["text"]) == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), (" \n", ""), ("plain text", "plain text"), ("<p>", ""), ("<nav>x</nav>", ""), ("<!-- never ended", ""), ("<script>x", ""), ("a < b & c", "a < b & c"),
    ("<h1>Only a heading</h1>", "Only a heading"), ("<a href=x>only a link</a>", "only a link"), ("</p></div>loose</table>", "loose"), ("<p>a&eacute;&#x41;&amp;amp;&nbsp;b", "aéA&amp; b")])
def test_odd_pages(page, text):
    assert article.main_text(page) == text


CLUTTER = ["<nav><a href=/>Home</a> of, all, things, that, are, menus</nav>", "<header><p>Site, of, many, commas, and, words</p></header>", f"<footer>{PROSE}</footer>",
           f"<aside><p>{PROSE}</p></aside>", f"<div class='cookie-notice'>{PROSE}</div>", f"<div id=sidebarRight><p>{PROSE}</p></div>", f"<form><p>{PROSE}</p></form>",
           f"<script>var x = '<p>{PROSE}</p>'</script>", f"<style>p{{}}</style><!-- <p>{PROSE}</p> -->", f"<section id='comments'><p>{PROSE}</p><p>{PROSE}</p></section>", f"<div class='ad'>{PROSE}</div>",
           f"<div role=dialog>{PROSE}</div>", f"<noscript>{PROSE}</noscript>"]


@pytest.mark.parametrize("tag", ["<article>", "<div class='post has-sidebar'>", "<main>", "<td>"])
@pytest.mark.parametrize("clutter", CLUTTER)
def test_clutter_is_cut_inside_and_around(tag, clutter):
    end = "</" + re.match(r"<(\w+)", tag)[1] + ">"
    page = f"<body>{clutter}{tag}<h1>Title <i>here</i></h1>{clutter}<p>{PROSE}<p>{PROSE} <a href=x>link</a><br>end<ul><li>one<li>two</ul>{clutter}{end}{clutter}"
    assert article.main_text(page) == f"Title here\n{PROSE}\n{PROSE} link end\none\ntwo"


def test_best_container_and_siblings():
    links = "<div><ul>" + "".join(f"<li><a href=/{k}>some, link, text {k}</a></li>" for k in range(30)) + "</ul></div>"
    assert article.main_text(f"{links}<div><p>{PROSE}</p><p>{PROSE}</p></div><div><p>{PROSE}</p></div>{links}") == "\n".join([PROSE] * 3)
    split = f"<article><header><h1>T</h1><p>by line</p></header><section><p>{PROSE}</p><p>{PROSE}</p></section><section><p>Q.</p></section></article>"
    assert article.main_text(split) == f"T\n{PROSE}\n{PROSE}\nQ."
    assert article.main_text(f"<form id=page><div><p>{PROSE}</p><p>{PROSE}</p></div></form><p>x</p>") == f"{PROSE}\n{PROSE}"


def test_deep_and_long_pages_end():
    assert article.main_text("<div>" * 30_000 + PROSE + "</div>" * 30_000) == PROSE
    assert article.main_text("<b>hello " * 20_000 + "</i>" * 20_000) == " ".join(["hello"] * 20_000)
    assert len(article.main_text(f"<p>{PROSE}" * 20_000)) == 20_000 * (len(PROSE) + 1) - 1


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, f"<p>{PROSE}</p>", 2), (2, "v", "", 3)]
    got = article.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, got.collect())) == sorted(map(str, [*[got.limit(0).sparkSession.createDataFrame([r], got.schema).first() for r in [
        (1, "u", "", 0), (1, "u", "", 0), (None, None, PROSE, len(PROSE)), (2, "v", "", 0)]]]))
    assert article.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
