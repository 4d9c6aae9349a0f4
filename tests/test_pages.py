"""The tree of elements, selectors, and what is read of pages."""

import time
from datetime import date

import pytest

from spindrift.sources import html
from spindrift.sources.dom import Tree, compiled, tidy
from spindrift.sources.markup import END, START, TEXT, attributes, closes_itself, events

ROOTS = ["example.org"]


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_events_of_odd_marks():
    said = list(events("<P Class='a>b'>x &amp; y<br/><!-- <p> -->< 3<script>if (a<b) '</p>'</script><!DOCTYPE x></ p></q"))
    assert said == [
        (START, "p", " Class='a>b'"), (TEXT, "x & y", ""), (START, "br", "/"), (TEXT, "<", ""), (TEXT, " 3", ""), (START, "script", ""), (TEXT, "if (a<b) '</p>'", ""), (END, "script", ""),
    ]
    assert list(events(None)) == list(events("")) == [] and list(events("<p")) == [] and list(events("a<!-- b")) == [(TEXT, "a", "")]
    assert list(events("<title>A &lt; B</TITLE >c")) == [(START, "title", ""), (TEXT, "A < B", ""), (END, "title", ""), (TEXT, "c", "")]
    assert attributes(" a=1 B='x &amp; y' a=2 c d=\"\" href=/p/?q=1&amp;r=2") == {"a": "1", "b": "x & y", "c": "", "d": "", "href": "/p/?q=1&r=2"}
    assert closes_itself("/") and closes_itself(" a='x'/") and not closes_itself(" href=/a/") and not closes_itself("")


def test_tree_knows_parents_spans_and_texts():
    t = Tree("<ul class=x><li>one<li id=b>two <i>and</i></ul><p>end")
    assert [t.tag[i] for i in t.select("*")] == ["ul", "li", "li", "i", "p"]
    ul, first, second, i, p = range(1, 6)
    assert [t.parent[k] for k in (ul, first, second, i, p)] == [0, ul, ul, second, 0]
    assert t.text(ul) == "one two and" and t.text(second, "|") == "two|and" and t.end[ul] == p and t.text(0) == "one two and end"
    assert t.get(second, "id") == "b" and t.get(p, "id") is None


@pytest.mark.parametrize(
    "selector,found",
    [
        ("li", "1 2 3"), ("ul > li", "1 2"), ("ul li", "1 2 3"), (".a.b", "2"), ("#c, .b", "2 3"), ("[data-x]", "1"), ("li[data-x='y z']", "1"), ("[data-x~=z]", "1"), ("[class*='b']", "2 3"), ("[class^='a']", "2"), ("[class$='x']", "3"),
        ("div ul li .deep", "4"), ("div ul > li .deep", ""), ("div > .deep", ""), ("  li  >  span.deep ", "4"), ("li.nope, span", "4"), ("[data-x='']", ""),
    ],
)
def test_selectors(selector, found):
    t = Tree("<div><ul><li n=1 data-x='y z'>a</li><li n=2 class='a b'>b</li></ul><ul><ol><li n=3 id=c class='b x'><span class=deep n=4>c</span></li></ol></ul></div>")
    assert " ".join(t.get(i, "n") for i in t.select(selector)) == found


def test_selectors_that_are_none():
    for bad in ("", "li >", "> li", "li:hover", "a,,b", "[x"):
        with pytest.raises(ValueError):
            compiled(bad)
    t = Tree("<table class=l><tbody><tr><td><a href=1>x</a></td></tr></tbody></table>")
    row = t.first_of("tr")
    assert t.first_of("table.l a[href]", row) is not None, "what a selector names above may lie outside of the row"
    assert t.first_of("tr", row) is None


def test_open_links_and_headings_end_where_the_next_begins():
    page = "<a href=x><b>w " * 20_000
    began = time.perf_counter()
    found = html.read(page + "<h2>t " * 20_000, "https://example.org/")
    assert len(found["links"]) == 20_000 and len(found["headings"]) == 1 and time.perf_counter() - began < 20


def test_tidy_and_clean():
    assert tidy("  a \t　b\r\n\r\n c\x0b") == "a b\nc"
    page = "<body><nav>n</nav><p>A<b>B</b></p><div style='DISPLAY : none'>h</div><p hidden>h</p><p aria-hidden=TRUE>h</p><aside>s</aside><div style='visibility: hidden'>v</div><script>x</script>C"
    assert html.clean(Tree(page)) == "A\nB\nC"
    assert html.clean(Tree(page + "<div class='x meditor'>M</div>")) == "M"
    assert html.clean(Tree(page + "<div class='x meditor'>M</div><main>N</main><main>O</main>")) == "N"
    assert html.clean(Tree("<main hidden>N</main><div class=meditor>M</div>")) == "M"
    assert html.clean(Tree("no marks")) == "no marks" and html.clean(Tree(None)) == ""


def test_page_of_a_list(spark):
    row = "<div class='row listBS'><div class=mtitle><a href='{}'>{}</a></div>{}</div>"
    listed = row.format("/p/406-1-2.php", "First", "") + row.format("/n", "Undated", "") + row.format("/n", "Second", "<i class=mdate>113-02-03</i><div class=mdetail>Say</div>") + row.format("/n", "Again", "<i class=mdate>2024-1-1</i>") + row.format("#x", "Anchor", "<i class=mdate>2024-1-1</i>")
    df = pages(spark, ("https://www.example.org/list/", f"<title>T</title><h2>News</h2><h2>News</h2>{listed}"), ("https://www.example.org/p/406-9-9.php", "<h1>Long title of a page</h1><p>Long enough a body of it, on 2024/05/06.</p>"), ("https://www.example.org/x", None))
    read = html.parsed(df).cache()
    items = {r.url: r for r in html.items_of(read, ROOTS).collect()}
    assert set(items) == {"https://www.example.org/p/406-1-2.php", "https://www.example.org/n"}
    second = items["https://www.example.org/n"]
    assert (second.title, second.published_at, second.summary, second.position) == ("Second", date(2024, 2, 3), "Say", 2)
    assert items["https://www.example.org/p/406-1-2.php"].published_at is None
    found = {r.page_id: r for r in html.site_pages(read, ROOTS).collect()}
    assert [found[i].role for i in range(3)] == ["listing", "detail", "other"]
    assert found[0].headings == ["News"] and found[0].title == "T" and found[0].items == 2
    assert found[1].published_at == date(2024, 5, 6) and found[1].body.startswith("Long title of a page")
    assert found[2].title == "https://www.example.org/x" and found[2].body == ""
    read.unpersist()


def test_first_date_that_is_a_day_counts(spark):
    df = pages(
        spark,
        ("https://example.org/", "<meta name=date content='2024-02-30'><meta name=pubdate content='on 2023-01-02'><time datetime='2022-01-01'>x</time>"),
        ("https://example.org/", "<div class='my-date-box'>no day</div><span data-date='2021/3/4'></span><meta property='og:updated_time' content=''>"),
        ("https://example.org/", "<p>1999年12月31日</p>"),
        ("https://example.org/", "<p>13-1-1</p>"),
    )
    days = {r.page_id: r.published_at for r in html.site_pages(html.parsed(df), ROOTS).collect()}
    assert days == {0: date(2023, 1, 2), 1: date(2021, 3, 4), 2: date(1999, 12, 31), 3: None}


def test_links_merge_labels_in_order(spark):
    page = "<a href='/a#x' title=' T '>One</a><a href='/b.pdf'>f</a><a href='mailto:x'>m</a><a href='https://other.net/'>o</a><a href='http://example.org/c'>h</a><a href='a'>Two</a><a href='/a'>One</a><a href='/a' aria-label='L'></a><a name=x>n</a><a href='//example.org/d%2ce?q=1'>D</a>"
    got = sorted((r.position, r.url, r.label) for r in html.links(pages(spark, ("https://example.org/", page)), ROOTS).collect())
    # A label is what its own link says whole: "T One" and "One" are two.
    assert got == [(0, "https://example.org/a", "T One Two One L"), (7, "https://example.org/d,e?q=1", "D")]


def test_listings_by_selectors(spark):
    s = html.Selectors(".l", "li", ".d", "a[data-u]", "data-u")
    item = "<li><a data-u='{}'>{}</a><i class=d>{}</i></li>"
    good = "".join([item.format("/p/404-1-2.php", "Ａ one", "2024-01-01"), item.format("/p/406-1-2,r3.php", "other", "2024-02-01"), item.format("/x", "a One", "113/1/1"), item.format("/y", "New", "2024-05-05"), item.format("/z", "", "2024-05-05"), item.format("/z", "bad", "soon"), item.format("https://no.net/z", "off", "2024-05-05"), item.format("/same", "Same day", "2024-05-05"), "<li>nothing</li>"])
    df = pages(spark, ("https://www.example.org/", f"<div class=l>{good}</div>"), ("https://www.example.org/", "<div></div>"), ("https://www.example.org/", "<div class=l></div>"), ("https://www.example.org/", "<div class=l><li>x</li></div>"), (None, None))
    got = {r.page_id: r for r in html.listings(df, s, ROOTS, "unit").collect()}
    assert [got[i].failure for i in range(5)] == [None, html.NO_LIST, html.NO_ITEM, html.NO_VALID, html.NO_LIST]
    # The second row has the first one's url identity, the third its title identity; the newest are first, ties as they stand.
    assert [i.title for i in got[0]["items"]] == ["New", "Same day", "Ａ one"]
    assert got[1]["items"] == [] and got[0]["items"][0].url == "https://www.example.org/y"
    assert html.listings(df.limit(0), s, ROOTS, "unit").collect() == []


def test_detail_by_selector(spark):
    df = pages(spark, ("u", "<div id=c><nav>n</nav>Text <b>here</b></div>rest"), ("u", "none"))
    assert [r.body for r in html.detail(df, "#c").orderBy("page_id").collect()] == ["Text\nhere", None]
    assert [r.body for r in html.detail(df).orderBy("page_id").collect()] == ["Text\nhere\nrest", "none"]


def test_search_form_and_results(spark):
    form = "<form action='?x=1' method=POST><input type=hidden name=t value=1><input type=hidden><input name=SchKey><select name=SchType><option>All<option value=1>One<option value=2>Two</select></form>"
    result = "<div id=assopartlist><div class=d-item><div class=mtitle><a href=/a>First</a></div><i class=mdate>113.2.3</i><b class=unit>U</b></div><div class=d-item><a href=/b>Second</a> 2024/1/1</div><div class=d-item>none</div></div>"
    df = pages(spark, ("https://example.org/s", form + result), ("https://example.org/s", form.replace("POST", "put")), ("https://example.org/s", form.replace("?x=1", "//else.net/")), ("https://example.org/s", "<form></form>"), (None, None))
    got = {r.page_id: r for r in html.search_forms(df, ROOTS).collect()}
    assert [got[i].failure for i in range(5)] == [None, "method", "action", "no form", "no form"]
    assert (got[0].method, got[0].action, got[0].fields, got[0].kinds) == ("post", "https://example.org/s?x=1", {"t": "1"}, ["1", "2"])
    assert {r.page_id: r.failure for r in html.search_forms(df, ROOTS, kind=None).collect()} == {0: None, 1: "method", 2: None, 3: "no form", 4: "no form"}
    rows = sorted((r.page_id, r.position, r.title, r.unit, r.published_at) for r in html.search_results(df, ROOTS, "site").collect() if r.title)
    assert rows == [(0, 0, "First", "U", date(2024, 2, 3)), (0, 1, "Second", "site", date(2024, 1, 1))]
    assert html.search_results(df, ROOTS, "site").where("title is null").count() == 4


def test_forms_without_a_keyword_are_listed_too(spark):
    got = html.form_table(pages(spark, ("https://example.org/d/", "<form action='/find' method='POST'><input type=hidden name=k value=1><input name=q></form><form></form>"))).collect()
    assert [(r.action, r.method, r.fields, r.names) for r in got] == [("https://example.org/find", "post", {"k": "1"}, ["k", "q"]), ("https://example.org/d/", "get", {}, [])]
