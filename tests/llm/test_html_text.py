from __future__ import annotations

import html
import re

import pytest

from clickloom.llm import html_text
from clickloom.llm.html_text import extract, main_text

from ..conftest import SF

SITE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="page no-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies, yes, many.</div>
<div id="content"><div class="post"><h2>A title, here</h2>
<p>First  para,\n with &eacute;t&eacute; and <a href="/x">a link</a>.<p>Second one<br>broken &lt;b&gt; line &amp; more.
<ul><li>item one<li>item two</ul><blockquote><p>quoted</p></blockquote>
<form><label>Mail</label><input value="x"> Subscribe</form></div>
<div class="comments"><p>Great post, really, love it, yes, yes</p></div></div>
<aside><p>Side, bar, with, many, commas</p></aside><div class="ad">Buy, now</div>
<script>if (a < b) { "</p>" }</script><footer>&copy; foot</footer></body></html>"""


def test_article_alone():
    assert main_text(SITE).split("\n") == ["A title, here", "First para, with été and a link.", "Second one broken <b> line & more.", "item one", "item two", "quoted"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("   ", ""), ("plain &amp; text <3", "plain & text <3"),
        ("<p>a<p>b</p></p>c", "a\nb\nc"), ("<p>cut <b>off</b> here<a hre", "cut off here"),
        ("<div hidden><p>no</p></div><p>yes</p>", "yes"), ("<p>x<!-- <p>no</p> -->y</p>", "xy"),
        ('<p title="a>b">kept</p>', "kept"), ("<table><tr><td>1<td>2</table>", "1\n2"),
        ("<article><p>in</p></article><footer>out</footer>", "in"), ("<p>open <script>never closed", "open"),
    ],
)
def test_small_pages(page, want):
    assert main_text(page) == want


def test_sections_of_an_article_stay_together():
    parts = "".join(f"<section><h2>Part {k}</h2><p>{'word, ' * (3 + 40 * (k % 2))}</p></section>" for k in range(6))
    got = main_text(f"<body><main>{parts}</main><div class='related'><p>{'other, ' * 90}</p></div></body>")
    assert got.count("Part") == 6 and "other" not in got


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "x") == "x"
    assert main_text("<p>a <b>" * 5_000).count("\n") == 4_999
    assert len(main_text("<article><p>" + "word " * 200_000 + "</p></article>")) == 999_999


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[row["page_id"]]["text"] == want and got[row["page_id"]]["n_chars"] == len(want)


def test_rows_stay(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    pages = spark.createDataFrame([(1, None, None, "x", "y"), (None, "u", "<p>a</p>", "x", "y"), (1, None, None, "x", "y")], schema)
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract(pages).collect()) == [(0, "a", 1), (1, "", 0), (1, "", 0)]
    assert extract(pages.limit(0)).count() == 0


BODY = "<h1>A title</h1><p>First, of some, words.</p><p>Second, of others.</p>"
ASIDES = "<div class='sidebar'><p>side, bar</p></div><div id='comments'><p>Great, post, really, love it, yes</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout has-sidebar'>{BODY}{ASIDES}</div>",
        f"<div id='page' class='no-sidebar'><div class='content'>{BODY}</div>{ASIDES}</div>",
        f"<main class='with-comments'>{BODY}{ASIDES}</main>",
        f"<article class='post share-enabled tags-news'>{BODY}</article>{ASIDES}<p>Legal, line, all rights</p>",
        f"<div class='layout tags-news'><article>{BODY}</article>{ASIDES}</div><p>Legal, line</p>",
        f"<div class='overflow-hidden'><div>{BODY}</div>{ASIDES}</div><footer>foot</footer>",
        f"<form id='aspnetForm' method='post'><div>{BODY}</div>{ASIDES}<form class='search'>Find</form></form>",
        f"<div>{BODY}</div>{ASIDES}<form>Subscribe, now</form>",
    ],
)
def test_named_wrappers_keep_the_article(page):
    assert main_text(f"<html><body>{page}</body></html>").split("\n") == ["A title", "First, of some, words.", "Second, of others."]


def test_names_do_not_empty_a_page():
    assert main_text("<div class='promo'><p>only this</p></div>") == "only this"
    assert main_text("<nav><a href='x'>A</a></nav><footer>foot</footer>") == ""


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>one <svg class='i'/> two</p><p>three</p>", "one two\nthree"),
        ("<p>one<svg/></p><p>two</p><svg><text>no</text></svg><p>three</p>", "one\ntwo\nthree"),
        ("<p>a <math/> b</p><p>c</p>", "a b\nc"),
        ("<p>a</p><svg><svg/><svg><text>no</text></svg>no</svg><p>b</p>", "a\nb"),
        ("<p>a</p><svg class='open'><path/><p>b</p><svg><text>no</text></svg><p>c</p>", "a\nb\nc"),
        ("<p>a</p><svg><text>no</text><desc>x</desc></svg><p>b</p>", "a\nb"),
    ],
)
def test_self_closed_and_open_icons(page, want):
    assert main_text(page) == want


LONG = "A paragraph of the article, which goes on for a while, with commas, until it ends. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # a list of sources below the prose, in an article and in a plain container
        (f"<article><p>{LONG}</p><h2>Sources</h2><ul><li><a href='1'>One</a><li><a href='2'>Two</a><li><a href='3'>Three</a></ul></article>",
         [LONG.strip(), "Sources", "One", "Two", "Three"]),
        (f"<div><ul><li><a href='1'>One</a><li><a href='2'>Two</a><li><a href='3'>Three</a></ul><p>{LONG}</p>"
         "<ul><li><a href='1'>Four</a></ul></div>", [LONG.strip(), "Four"]),
        # names of topics, looks and anchors
        (f"<article><p>{LONG}</p><section class='legal-history'><p>Laws, old.</p></section><p class='notice'>Note well.</p>"
         "<h2 id='form'>Form of government</h2><p class='ad'>Buy, now</p><div class='related-posts'><p>Other, texts</p></div></article>",
         [LONG.strip(), "Laws, old.", "Note well.", "Form of government"]),
        (f"<article><p>{LONG}</p><p id='comments'>On comments.</p><div class='theme-x-sidebar'>side</div><div class='cookie-recipes'>Bake.</div></article>",
         [LONG.strip(), "On comments.", "Bake."]),
        # short parts beside the best container
        (f"<body><div><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{LONG}</p></div></body>", [LONG.strip(), "Short.", LONG.strip()]),
        (f"<body><div class='part'><p>{LONG}</p></div><div class='part x'><p>Go</p></div><div class='part'><p>Short</p></div></body>",
         [LONG.strip(), "Go", "Short"]),
        (f"<body><p>Short one.</p><div><p>{LONG}</p></div><p><a href='/'>Home.</a></p></body>", ["Short one.", LONG.strip()]),
    ],
)
def test_articles_stay_whole(page, want):
    nav = "<nav><a href='/'>A</a><a href='/b'>B</a><a href='/c'>C</a></nav>"
    assert main_text(f"<html>{nav}{page}<footer>foot</footer></html>").split("\n") == want


def plain_best(page):
    """Tree scoring without the shortcuts: points of each block, from each block up, for each node."""
    blocks = [(node, t, links) for node, pieces, links in page.runs if (t := " ".join("".join(pieces).split()))]
    up = lambda k: [k, *up(page.parent[k])] if k > 0 else []
    found = []
    for k in range(len(page.tag)):
        points = size = linked = 0.0
        for node, t, links in blocks:
            way = up(page.parent[node] if page.tag[node] in html_text.LEAVES else node)
            if k in way:
                earned = (1 + sum(t.count(c) for c in ",،、，") + min(len(t) / 100, 3)) * (1 - min(1.0, links / len(t)))
                points += earned / 2 ** way.index(k) if earned / 2 ** way.index(k) > 1e-3 else 0
            if k == 0 or k in up(node):
                size, linked = size + len(t), linked + links
        found.append(points * (1 - min(1.0, linked / size)) if size else 0.0)
    return found, blocks


def test_scores_against_plain_tree_scoring(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect()] + [SITE]
    for text in pages:
        page = html_text.Page(text)
        want, blocks = plain_best(page)
        got, _, _ = html_text._scores(page, blocks, [1.0] * len(page.tag))
        assert got == pytest.approx(want)
