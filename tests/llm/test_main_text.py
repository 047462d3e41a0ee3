"""Main text of pages: the scan, the parser, and whole pages."""

import html
import os
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rotaloom.llm import main_text as M

SF = "/root/testdata/sf0.001"


@given(st.lists(st.integers(-5, 5), max_size=30))
def test_best_run_is_the_largest_sum(scores):
    low, high = M.best_run([float(s) for s in scores])
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    assert sum(scores[low:high]) == max(best, 0)


PAGE = """<!DOCTYPE html><html><head><title>T t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">menu one</a></li><li><a href='>'>menu two</a></li></ul></nav><div class="ad banner">Buy this now</div>
<article><h1>Head &amp; line</h1><p>First <b>bo</b>ld&nbsp;text<br>here.<p>Second  paragraph with several words
in it.<div class="share-buttons">Share me</div><form><label>Mail</label></form><p>Third &#233;nd &lt;tag&gt;.</p>
<section id="comments"><p>Nice article says a reader</p></section></article><aside>Side words stand here</aside><footer>&copy; words</footer>"""


def test_page():
    n = M.count_tokens(PAGE)
    weights = M.weigh([(kind, key, n[kind, key, True], n[kind, key, False]) for kind, key in {k[:2] for k in n}])
    want = "Head & line\n\nFirst bold text here.\n\nSecond paragraph with several words in it.\n\nThird énd <tag>."
    assert M.main_text(PAGE, weights) == want
    assert M.main_text(PAGE, M.Weights()) == want  # by the default scores as well


@pytest.mark.parametrize("page", ["", "plain", "<p", "<p class='x>text", "<<<>>>", "<script>never closed <p>x", "</div></p>", "<!-- open", "<a " * 2000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(M.main_text(page, M.Weights()), str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")
def test_marked_articles_come_back(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = M.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "<p>some words here", 2), (1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, "v", "<p>" + "w " * 200_000, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _html int").drop("_html").selectExpr("*", "5 as text")
    got = M.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in got.collect()) == [0, 15, 96, 96, 399_999]
    assert M.extract(pages.limit(0)).count() == 0


ARTICLE = "<h1>Some title</h1><p>One sentence of the text stands here.<p>And then another sentence follows it."
WANT = "Some title\n\nOne sentence of the text stands here.\n\nAnd then another sentence follows it."


@pytest.mark.parametrize("mark", ["article", "div"])
@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout has-sidebar">{}</div>',
        '<div class="post with-comments">{}<div id="comments"><p>Nice one</p></div></div>',
        '<section class="social-policy">{}</section>',
        '<form id="aspnetForm" action="/">{}</form>',
        '<form><nav><a href="/">Home page</a></nav>{}<div class="share-buttons">Share it</div></form>',
        '<p>A <svg/> b</p>{}',
        '<ul><li class=share>Share</ul>{}',
        '<div class="sidebar"><div>{}</div></div>',
        '<div class="widget">{}<ul><li class="ad">Buy<li>not this</ul></div>',
    ],
)
def test_wrappers_keep_their_article(page, mark):
    got = M.main_text("<html><body>" + page.format(f"<{mark}>{ARTICLE}</{mark}>") + "</body></html>", M.Weights())
    assert WANT in got and not any(w in got for w in ("Nice", "Share", "Home", "Buy"))


def test_implied_ends():
    page = "<article><ul><li class=share>Share me<li>A point of the article</ul><table><tr><td class=ad>Buy<td>One cell of it<tr><td>Next row of it</table></article>"
    assert M.main_text(page, M.Weights()) == "A point of the article\n\nOne cell of it\n\nNext row of it"


@pytest.mark.parametrize(
    "name, other",
    [("share-buttons", True), ("ad banner", True), ("site-header", True), ("post-header", False), ("mainNav", True), ("has-sidebar", False),
     ("social-policy", False), ("with-comments", False), ("comments-area", True), ("related_posts", True), ("header", False), ("ad-free", False), ("", False)],
)
def test_names_of_parts(name, other):
    assert M.other_part(name) == other


def test_comments_marked_as_articles():
    page = f"<div><div class=x>{ARTICLE}</div><div id=comments><article class=comment><p>I say this</article><article><p>Me too I say</article></div></div>"
    assert M.main_text(page, M.Weights()) == WANT
