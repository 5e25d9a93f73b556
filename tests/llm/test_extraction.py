import itertools
import random

import pytest

from tallyframe.llm import extraction as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body>
<header class="site"><h1>Site name</h1></header><div id="cookie-notice"><p>We use cookies to do things. Accept all of them.</p></div>
<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><!-- <p>hidden</p> -->
<div class="post-content"><h2>A title</h2><p>Long text of the article &amp; its many words, which go on and on, as they must.<p>Short <b>bold</b>.
<div class="ad">Buy now this thing, which is good for everyone and all of us.</div><blockquote>A quote&nbsp;here<br>broken</blockquote>
<form><p>Your name here, please</p><input></form></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href=1>One thing</a></ul></div>
<section id="comments"><p>I agree with this very much, what a good article it is.</p></section><footer>&copy; 2020 All rights reserved.</footer></body></html>"""


def test_article_without_its_surroundings():
    assert X.main_text(PAGE) == (
        "A title Long text of the article & its many words, which go on and on, as they must. Short bold. A quote here broken")


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html>", ""), ("<p>Just one sentence with some words in it, and no more.", "Just one sentence with some words in it, and no more."),
    ("<article><p>a < b and <3 this, as people write it every day.</p>", "a < b and <3 this, as people write it every day."),
    ("<article><p>Open <b>tags<p>and &am broken &lt;ends&gt; of the page", "Open tags and &am broken <ends> of the page"),
    ("<script>never closed <p>text", ""), ("<!-- never closed <p>text", "")])
def test_broken_pages(page, text):
    assert X.main_text(page) == text


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 9)
        scores = [round(rng.gauss(0, 2), 2) for _ in range(n)]
        edges = [(a, b, round(rng.random() * 2, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        best = min(X.labelling_cost(scores, edges, list(c)) for c in itertools.product([True, False], repeat=n))
        assert X.labelling_cost(scores, edges, X.minimum_cut(scores, edges)) == pytest.approx(best)


def test_operator(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "word " * 30_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    found = X.extract_main_text(pages).collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in found) == sorted((str(a), str(b), X.main_text(c)) for a, b, c in rows)
    assert all(r.n_chars == len(r.text) for r in found)
    assert X.extract_main_text(pages.limit(0)).collect() == []

LONG = "The long text of an article with its many words, which go on and on for a while, as every article's words must do here."


@pytest.mark.parametrize("names", ["article overflow-hidden", "layout has-sidebar", "content no-sidebar", "post more-space", "col side-by-side"])
def test_layout_names_do_not_cut_the_article(names):
    assert X.main_text(f'<body><div class="{names}"><article><p>{LONG}</p></article></div></body>') == LONG
    assert X.main_text(f'<body><article class="{names}"><p>{LONG}</p></article></body>') == LONG


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "related-posts", "commentList", "site_footer"])
def test_names_of_surroundings_cut(name):
    assert X.main_text(f'<body><article><p>{LONG}</p></article><div class="{name}"><p>{LONG}</p></div></body>') == LONG


@pytest.mark.parametrize("tag", ["svg", "math", "object", "canvas", "video", "audio", "select"])
def test_unclosed_element_is_skipped_alone(tag):
    assert X.main_text(f"<body><article><{tag}><p>{LONG}</p></article></body>") == LONG
