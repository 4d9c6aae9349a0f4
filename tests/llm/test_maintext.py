import html as library
import re
import time

import numpy as np
import pytest

from spindrift.llm import maintext
from spindrift.llm.maintext import main_text

LONG = "This is a paragraph of an article that has a good many words in it, as paragraphs of articles do."

PAGES = {
    "article element": (
        f"""<body class="single has-sidebar comments-open"><header class="site-header"><h1>My site</h1><p>Tagline</p></header><nav><a href=1>A</a> <a href=2>B</a></nav>
<div class="cookie-banner"><p>We use cookies. {LONG}</p></div><main><article><header><h1>Title of it</h1></header><p>First with <b>bold</b> text,<br>and&nbsp;a   break.</p>
<div class="ad">Buy this. {LONG}</div><h2>Sub &amp; more</h2><ul><li>one item</li><li>two items</li></ul><p>Last.</p><aside>{LONG}</aside></article>
<section id="comments"><h3>3 Comments</h3><article class="comment"><p>{LONG}</p></article></section></main><aside class="sidebar"><h3>Popular</h3><p>{LONG}</p></aside>
<form><label>Email</label><p>{LONG}</p></form><footer><p>About us. {LONG}</p></footer><script>if(a<b){{document.write("<p>no</p>")}}</script></body>""",
        "Title of it\nFirst with bold text, and a break.\nSub & more\none item\ntwo items\nLast.",
    ),
    "plain divisions": (
        f"""<div class="wrapper"><div class="header"><a href=/>Logo</a></div><div class="menu"><ul><li><a href=a>Aa</a><li><a href=b>Bb</a></ul></div><div class="content"><h1>Hello world</h1>
<div class="entry"><p>{LONG}<p>Unclosed second.<p>3rd</div></div><div class="comments"><h4>Comments</h4><p>bob: {LONG}</p></div><div class="footer">Foot text</div></div>""",
        f"Hello world\n{LONG}\nUnclosed second.\n3rd",
    ),
    "no marks at all": (
        f"""<title>Site</title><div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/c">Contact</a></div><h1>Real title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div>&copy; 2024 Somebody. All rights reserved.</div>""",
        f"Real title\n{LONG}\nShort.\n{LONG}",
    ),
    "comments under a heading": (f"<article><h1>T</h1><p>{LONG}</p><h2>Comments</h2><p>{LONG}</p><p>ok</p></article>", f"T\n{LONG}"),
    "links in an article": (
        f'<article><h1>T</h1><p>{LONG} <a href="x">with a link</a> in it.</p><ul><li><a href=1>Other page one</a></li><li><a href=2>Other page two</a></li><li><a href=3>Other page three</a></li></ul><h2><a href="#s">Part</a></h2><p>{LONG}</p></article>',
        f"T\n{LONG} with a link in it.\nPart\n{LONG}",
    ),
    "first and only": ("<article><p>One.</p></article>", "One."),
    "cut off": ("<article><h1>Title</h1><p>Some words <b>and", "Title\nSome words and"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert main_text(page) == want


def test_held_out_blocks():
    pages = maintext.labelled_pages(200, seed=99)
    x, y = maintext.labelled_rows(pages)
    x[:, 0] -= 1
    x[1:, 2] -= 1
    x[:-1, 4] -= 1
    found = maintext.tree().predict(np.maximum(x, 0)) >= 0.5
    assert (found == y).mean() > 0.97 and found[y == 1].mean() > 0.98


def test_a_tree_fits_what_can_be_told_apart():
    x = np.array([[i % 7, i % 5] for i in range(200)], float)
    y = ((x[:, 0] > 3) & (x[:, 1] <= 2)).astype(float)
    assert ((maintext.Tree(x, y).predict(x) >= 0.5) == y).all()
    assert (maintext.Tree(x, np.ones(200)).predict(x) == 1).all()


def test_odd_pages(spark):
    rows = [
        (1, "u", None, "a"), (2, None, "", "a"), (None, "u", "<p>", "a"), (3, "u", "no marks, " + LONG, "a"), (3, "u", "no marks, " + LONG, "a"), (4, "u", "<<<>><a b='", None), (5, "u", "<article>a < b &lt;c&gt; &amp;amp;</article>", ""),
        (6, "u", "<article><p>x" + "<p>y" * 20_000, ""), (7, "u", "</p></div><!-- never closed <p>a</p>", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = maintext.op13(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = [r.text for r in sorted(got.collect(), key=lambda r: (r.page_id or 0))]
    assert texts[:3] == ["", "", ""] and texts[3] == texts[4]
    assert texts[6] == "a < b <c> &amp;" and texts[7] == "\n".join(["x"] + ["y"] * 20_000) and texts[8] == ""
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert maintext.op13(df.limit(0)).collect() == []


def test_time_is_linear_in_the_page():
    took = []
    for n in (20_000, 80_000):
        page = "<div><p class=x>some words <a href=y>here</a>" * n
        began = time.perf_counter()
        maintext.blocks(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_against_its_own_articles(spark, sf):
    """The pages of the test tables hold one article element; its blocks, cut out by patterns, are the text."""
    df = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: r.text for r in maintext.op13(df).collect()}
    for r in df.collect():
        own = re.search("<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(library.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", own)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)
