"""Pages of a site: text, headings, day, links, list items, role, forms and search results.

A page is read once, into a tree of arrays (`dom.Tree`) that compiled selectors run over; what comes out is one nested
struct. What urls, dates and roles mean is said by column expressions over that struct.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from spindrift.functions import text, urls
from spindrift.operators import announcements, documents
from spindrift.shipping import ship
from spindrift.sources.dom import Tree, tidy

#: Fixed: elements whose text is not content, and where the content is looked for.
DROPPED = frozenset({"script", "iframe", "style", "noscript", "nav", "header", "footer", "aside"})
CONTENT = ".meditor"
#: Fixed: where a title is looked for, in this order; and a day, in page order within each of the two.
TITLES = ("meta[property='og:title']", "meta[name='title']", "h1", "title")
DATED = (
    "meta[property='article:published_time'], meta[property='og:updated_time'], meta[name='date'], meta[name='publishdate'], meta[name='pubdate']",
    "time[datetime], [data-date], .date, .mdate, .pdate, [class*='date'], [id*='date']",
)
#: Fixed: rows of lists of announcements, what is looked for in a row, and what tells a list or a detail page.
ROWS = ".row.listBS, table.listTB tbody tr, .module .mtitle, .module-detail .mtitle, .mb .mtitle"
ROW_LINK, ROW_DATE, ROW_SUMMARY = ".mtitle > a[href], a[href]", "i.mdate, td[data-th='日期'], .mdate, .date, time, [data-date]", ".mdetail, .summary, .mcont, .d-txt, td[data-th='內容']"
ROW_AROUND = frozenset({"d-txt", "row", "listBS"})
LISTS, DETAILS = ".row.listBS, table.listTB tbody tr, .module .mtitle", "article, .mpgdetail, .module-detail, .news-detail, .article-detail, [class*='detail']"
#: Fixed: results of the site's own search, and what is looked for in one.
RESULTS, RESULT_ROW, RESULT_ROWS = "#assopartlist, #assocomlist, [data-search-results], .assosearch, .search-results, #assosearch", ".d-item", "tr, li, article"
RESULT_DATE, RESULT_UNIT, RESULT_KIND = ".date, .mdate, [data-date]", ".unit, [data-unit], .subsitename", ".category, [data-category]"
#: Fixed: what a link must not begin with; a date in a text; one in a search result; the path of a detail page.
NO_LINK = ("#", "mailto:", "tel:", "javascript:")
_DATE = re.compile(r"\d{3,4}[年\-/.]\d{1,2}[月\-/.]\d{1,2}日?")
_RESULT_DATE = re.compile(r"(?:20\d{2}|1\d{2})[-/.年]\d{1,2}[-/.月]\d{1,2}")
DETAIL_PATH = "/p/406-"
#: Fixed: characters of a body that a day is looked for in.
DAY_WITHIN = 5_000


@dataclass(frozen=True)
class Selectors:
    """Where a list page holds its list, its items, and in an item the date and the link with the title."""

    listing: str
    item: str
    date: str
    title_link: str
    link_attribute: str = "href"


def _resolved(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:
        return ""


def gone(tree: Tree) -> list[bool]:
    """Which elements are no content: of the dropped kinds, hidden, or inside of such."""
    out = [False] * len(tree.tag)
    for i in range(1, len(out)):
        out[i] = out[tree.parent[i]] or tree.tag[i] in DROPPED
        if not out[i] and tree.rest[i]:
            a = tree.attrs(i)
            style = a.get("style", "").replace(" ", "").lower()
            out[i] = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    return out


def clean(tree: Tree, root: int = 0) -> str:
    """Lines of the content below `root`: of its main element, else the one of class meditor, else the body, else all."""
    out = gone(tree)
    inside = [i for i in range(root, tree.end[root]) if not out[i]]
    top = next((i for i in inside if tree.tag[i] == "main"), None)
    for wanted in (CONTENT, "body"):
        top = next((i for i in inside if i and tree.matches(i, wanted)), None) if top is None else top
    return tidy(tree.text(root if top is None else top, "\n", out))


def _title(tree: Tree) -> str:
    for selector in TITLES:
        i = tree.first_of(selector)
        found = "" if i is None else tidy(tree.get(i, "content") or "" if tree.tag[i] == "meta" else tree.text(i))
        if found:
            return found
    return ""


def _said(tree: Tree, i: int) -> str:
    return tree.get(i, "datetime") or tree.get(i, "data-date") or tree.text(i)


def _dates(tree: Tree) -> list[str]:
    """The date that each place for one tells, in order, without repeats: the first that is a day counts."""
    told = [tree.get(i, "content") or "" for i in tree.select(DATED[0])] + [_said(tree, i) for i in tree.select(DATED[1])]
    return list(dict.fromkeys(m[0] for m in map(_DATE.search, told) if m))


def _links(tree: Tree, url: str | None) -> list[dict]:
    out = []
    for i in range(1, len(tree.tag)):
        if tree.tag[i] == "a" and (href := (tree.get(i, "href") or "").strip()) and not href.startswith(NO_LINK):
            label = tidy(" ".join(x for x in ((tree.get(i, "aria-label") or "").strip(), (tree.get(i, "title") or "").strip(), tree.text(i)) if x))
            out.append({"url": _resolved(url, href), "label": label})
    return out


def _items(tree: Tree, url: str | None) -> list[dict]:
    out = []
    for order, i in enumerate(tree.select(ROWS)):
        row = i
        if "mtitle" in tree.classes(i):
            up = tree.parent[i]
            while up > 0 and not (tree.tag[up] == "tr" or ROW_AROUND.intersection(tree.classes(up))):
                up = tree.parent[up]
            row = up if up > 0 else i
        link = tree.first_of(ROW_LINK, i)
        href = "" if link is None else (tree.get(link, "href") or "").strip()
        title = "" if link is None else tidy(tree.text(link))
        if not href or href.startswith(NO_LINK) or not title:
            continue
        date, summary = tree.first_of(ROW_DATE, row), tree.first_of(ROW_SUMMARY, row)
        told = _DATE.search("" if date is None else _said(tree, date))
        anchor = tidy(" ".join(x for x in (tree.get(link, "title"), title) if x))
        out.append({"position": order, "url": _resolved(url, href), "title": title, "told": told[0] if told else None, "summary": "" if summary is None else tidy(tree.text(summary)), "anchor_text": anchor})
    return out


def read(html: str | None, url: str | None, decode: Callable[[str], str] = unescape) -> dict:
    """All of a page; broken mark-up gives what was read of it."""
    tree = Tree(html, decode)
    headings = (tidy(tree.text(i)) for i in tree.select("h1, h2, h3, h4, h5, h6"))
    return {
        "title": _title(tree), "body": clean(tree), "headings": [h for h in dict.fromkeys(headings) if h], "dates": _dates(tree), "links": _links(tree, url), "items": _items(tree, url),
        "lists": tree.first_of(LISTS) is not None, "details": tree.first_of(DETAILS) is not None,
    }


_LINK = "struct<url:string,label:string>"
_ITEM = "struct<position:long,url:string,title:string,told:string,summary:string,anchor_text:string>"
PAGE = f"title string, body string, headings array<string>, dates array<string>, links array<{_LINK}>, items array<{_ITEM}>, lists boolean, details boolean"


def _day(told: Column) -> Column:
    return text.parsed_date(F.nullif(F.regexp_extract(told, text.DATE, 0), F.lit("")))


def parsed(pages: DataFrame, html: str = "html", url: str = "url", decode: Callable[[str], str] = unescape) -> DataFrame:
    """`pages` with a struct column page: all that `read` finds, from one walk over the page; `decode` says what character references mean."""

    @F.pandas_udf(PAGE)
    def run(htmls: pd.Series, own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(h, u, decode) for h, u in zip(htmls, own, strict=True)], columns=[c.split()[0] for c in ("title", "body", "headings", "dates", "links", "items", "lists", "details")])

    ship(pages.sparkSession)
    return pages.withColumn("page", run(html, url))


def allowed(url: Column, roots: list[str], hosts: list[str] | None = None) -> Column:
    """Whether a page's link may be followed: https below the roots and, if given, the hosts, and no file of another kind."""
    fine = urls.is_allowed(url, roots) & urls.is_crawlable(urls.canonical(url))
    return fine if hosts is None else fine & urls.in_scope(urls.host(url), hosts)


def links_of(read_pages: DataFrame, roots: list[str], hosts: list[str] | None = None) -> DataFrame:
    """(page_id, position, url, label): each canonical target of a page once, its labels in order without repeats."""
    each = read_pages.select("page_id", F.posexplode("page.links").alias("position", "l")).where(allowed(F.col("l.url"), roots, hosts))
    named = each.select("page_id", F.col("position").cast("long").alias("position"), urls.canonical(F.col("l.url")).alias("url"), "l.label")
    one = named.groupBy("page_id", "url").agg(F.min("position").alias("position"), F.array_sort(F.collect_list(F.struct("position", "label"))).alias("all"))
    labels = F.array_distinct(F.filter(F.transform("all", lambda x: x["label"]), lambda x: x != ""))
    return one.select("page_id", "position", "url", F.array_join(labels, " ").alias("label"))


def items_of(read_pages: DataFrame, roots: list[str], hosts: list[str] | None = None) -> DataFrame:
    """(page_id, position, title, url, published_at, summary, anchor_text): announcements that a page lists.

    The first row of each target counts that has a day, or needs none because its path is a detail page's.
    """
    each = read_pages.select("page_id", F.inline("page.items")).where(allowed(F.col("url"), roots, hosts))
    known = each.select("page_id", "position", "title", urls.canonical(F.col("url")).alias("url"), _day(F.col("told")).alias("published_at"), "summary", "anchor_text")
    valid = known.where(F.col("published_at").isNotNull() | F.contains(F.lower(urls.path(F.col("url"))), F.lit(DETAIL_PATH)))
    first = valid.groupBy("page_id", "url").agg(F.min_by(F.struct("position", "title", "published_at", "summary", "anchor_text"), "position").alias("i"))
    return first.select("page_id", "i.position", "i.title", "url", "i.published_at", "i.summary", "i.anchor_text")


def site_pages(read_pages: DataFrame, roots: list[str], hosts: list[str] | None = None, most: int = 20_000) -> DataFrame:
    """(page_id, title, body, headings, published_at, items, role) of parsed pages (page_id, url, page).

    The title goes before the body, a page without one is called by its url, and `most` bounds a body as the site's
    index keeps it.
    """
    # As many as `items_of` gives, counted inside the row: no page is parsed or moved for it.
    told = F.filter("page.items", lambda x: allowed(x["url"], roots, hosts) & (_day(x["told"]).isNotNull() | F.contains(F.lower(urls.path(urls.canonical(x["url"]))), F.lit(DETAIL_PATH))))
    items = F.size(F.array_distinct(F.transform(told, lambda x: urls.canonical(x["url"])))).cast("long")
    p = lambda c: F.col(f"page.{c}")
    body = documents.page_body(p("title"), p("body"), most)
    rows = read_pages.select("page_id", "url", "page.title", body.alias("body"), "page.headings", p("dates").alias("dates"), "page.lists", "page.details", items.alias("items"))
    day = F.coalesce(F.get(F.filter(F.transform("dates", _day), lambda d: d.isNotNull()), F.lit(0)), _day(F.substring("body", 1, DAY_WITHIN)))
    rows = rows.withColumn("published_at", day)
    role = documents.page_role(F.col("items"), F.col("lists"), F.col("details"), urls.path(F.col("url")), F.col("title"), F.col("body"), F.col("published_at"))
    return rows.select("page_id", F.when(F.col("title") != "", F.col("title")).otherwise(urls.canonical(F.col("url"))).alias("title"), "body", "headings", "published_at", "items", role.alias("role"))


def cleaned(pages: DataFrame, decode: Callable[[str], str] = unescape) -> DataFrame:
    return parsed(pages, decode=decode).select("page_id", "page.title", "page.body")


def links(pages: DataFrame, roots: list[str], hosts: list[str] | None = None) -> DataFrame:
    """The links of pages (page_id, url, html), as in `links_of`."""
    return links_of(parsed(pages), roots, hosts)


# Lists by configured selectors

NO_LIST, NO_ITEM, NO_VALID = "no list", "no item", "no valid item"


def list_rows(html: str | None, url: str | None, s: Selectors) -> tuple[str | None, list[dict]]:
    """(failure, rows): every item of the lists of a page; a part that is missing is empty."""
    tree = Tree(html)
    roots = list(tree.select(s.listing))
    if not roots:
        return NO_LIST, []
    rows = [i for r in roots for i in tree.select(s.item, r)]
    out = []
    for i in rows:
        date, link = tree.first_of(s.date, i), tree.first_of(s.title_link, i)
        href = "" if link is None else (tree.get(link, s.link_attribute) or "").strip()
        out.append({"title": "" if link is None else " ".join(tree.text(link).split()), "url": _resolved(url, href) if href else "", "told": None if date is None else " ".join(tree.text(date).split())})
    return None if rows else NO_ITEM, out


@F.pandas_udf(ArrayType(BooleanType()))
def _unclaimed(keys: pd.Series, others: pd.Series) -> pd.Series:
    """For each row of a list whether neither of its two keys was claimed by a row that stayed."""

    def one(a, b):
        seen, out = (set(), set()), []
        for x, y in zip(a, b, strict=True):
            stays = x not in seen[0] and y not in seen[1]
            if stays:
                seen[0].add(x)
                seen[1].add(y)
            out.append(stays)
        return out

    return pd.Series([one(a, b) for a, b in zip(keys, others, strict=True)], dtype=object)


def listings(pages: DataFrame, selectors: Selectors, hosts: list[str], unit: str) -> DataFrame:
    """(page_id, failure, items array<struct<title, url, published_at>>): announcements of list pages (page_id, url, html).

    A row without date, title or link, with a date that is none, or off the hosts is left out. A row whose url identity
    or title identity was claimed by one that stayed goes. The newest come first, equal days in page order. A page
    without a list, without items or without a valid one is a failure and has no items.
    """

    @F.pandas_udf("failure string, rows array<struct<title:string,url:string,told:string>>")
    def run(htmls: pd.Series, own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([list_rows(h, u, selectors) for h, u in zip(htmls, own, strict=True)], columns=["failure", "rows"])

    ship(pages.sparkSession)
    found = pages.select("page_id", run("html", "url").alias("r")).select("page_id", "r.failure", "r.rows")
    kept = F.filter(
        F.transform("rows", lambda x: F.struct(x["title"].alias("title"), urls.canonical(x["url"]).alias("url"), text.parsed_date(x["told"]).alias("published_at"))),
        lambda x: (x["title"] != "") & x["published_at"].isNotNull() & F.rlike(x["url"], F.lit("^https://.")) & urls.in_scope(urls.host(x["url"]), hosts),
    )
    valid = found.select("page_id", "failure", kept.alias("rows"))
    # Identities fold letters of any width, which may call Python: keys are made row by row of the lists.
    flat = valid.select("page_id", F.posexplode("rows").alias("at", "x")).select("page_id", "at", "x", urls.content_identity(F.col("x.url")).alias("u"), announcements.identity(F.col("x.title"), F.col("x.published_at"), F.lit(unit)).alias("t"))
    gathered = flat.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "u", "t", "x"))).alias("all"))
    marked = gathered.withColumn("stays", _unclaimed(F.col("all.u"), F.col("all.t")))
    ordered = F.array_sort(F.transform(F.filter(F.arrays_zip("all", "stays"), lambda z: z["stays"]), lambda z: F.struct((-F.unix_date(z["all"]["x"]["published_at"])).alias("later"), z["all"]["at"].alias("at"), z["all"]["x"].alias("x"))))
    items = marked.select("page_id", F.transform(ordered, lambda o: o["x"]).alias("items"))
    joined = valid.select("page_id", "failure").join(items, "page_id", "left")
    return joined.select("page_id", F.coalesce("failure", F.when(F.col("items").isNull(), NO_VALID)).alias("failure"), F.coalesce("items", F.array().cast("array<struct<title:string,url:string,published_at:date>>")).alias("items"))


def detail(pages: DataFrame, selector: str | None = None, decode: Callable[[str], str] = unescape) -> DataFrame:
    """(page_id, body): the content of detail pages inside the first element of a selector; null where there is none."""

    def one(html):
        tree = Tree(html, decode)
        root = tree.first_of(selector) if selector else 0
        return None if root is None else clean(tree, root)

    @F.pandas_udf("string")
    def run(htmls: pd.Series) -> pd.Series:
        return htmls.map(one)

    ship(pages.sparkSession)
    return pages.select("page_id", run("html").alias("body"))


def listing(pages: DataFrame, pattern: str, roots: list[str]) -> DataFrame:
    """Items of list pages: links whose url matches, with the first date of their label; the newest first."""
    found = links(pages, roots).where(F.rlike("url", F.lit(pattern))).withColumn("published_at", text.parsed_date(F.col("label")))
    return found.orderBy(F.desc_nulls_last("published_at"), "page_id", "position")


# Search forms and results

_FORM = "struct<action:string,method:string,fields:map<string,string>,names:array<string>,choices:map<string,array<string>>>"


def forms(html: str | None, url: str | None) -> list[dict]:
    """The forms of a page: action, method, hidden fields, names of all fields, and the choices of its selects."""
    tree, out = Tree(html), []
    for i in tree.select("form"):
        hidden = {tree.get(k, "name"): tree.get(k, "value") or "" for k in tree.select("input[type='hidden'][name]", i) if tree.get(k, "name")}
        names = list(dict.fromkeys(n for k in tree.select("[name]", i) if (n := tree.get(k, "name"))))
        choices = {n: [v for o in tree.select("option", k) if (v := tree.get(o, "value"))] for k in tree.select("select[name]", i) if (n := tree.get(k, "name"))}
        out.append({"action": _resolved(url, tree.get(i, "action") or url or ""), "method": (tree.get(i, "method") or "get").lower(), "fields": hidden, "names": names, "choices": choices})
    return out


def form_table(pages: DataFrame) -> DataFrame:
    """(page_id, position, action, method, fields, names, choices) of every form."""

    @F.pandas_udf(f"array<{_FORM}>")
    def run(htmls: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([forms(h, u) for h, u in zip(htmls, own, strict=True)], dtype=object)

    ship(pages.sparkSession)
    return pages.select("page_id", F.posexplode(run("html", "url")).alias("position", "f")).select("page_id", F.col("position").cast("long").alias("position"), "f.*")


def search_forms(pages: DataFrame, roots: list[str], keyword: str = "SchKey", kind: str | None = "SchType") -> DataFrame:
    """(page_id, failure, method, action, fields, kinds): the first form of each page with a field for words and, unless
    `kind` is None, a choice of kinds. No such form, another method than get and post, or an action that is not allowed
    is a failure."""
    fits = F.array_contains("names", keyword)
    if kind is not None:
        fits = fits & F.map_contains_key("choices", kind)
    first = form_table(pages).where(fits).groupBy("page_id").agg(F.min_by(F.struct("method", "action", "fields", "choices"), "position").alias("f"))
    wrong = F.when(F.col("f").isNull(), "no form").when(~F.col("f.method").isin("get", "post"), "method")
    if kind is not None:
        wrong = wrong.when(~urls.is_allowed(F.col("f.action"), roots), "action")
    kinds = F.lit(None).cast("array<string>") if kind is None else F.element_at("f.choices", kind)
    return pages.select("page_id").join(first, "page_id", "left").select("page_id", wrong.alias("failure"), "f.method", "f.action", "f.fields", kinds.alias("kinds"))


_RESULT = "struct<title:string,url:string,told:string,unit:string,category:string,body:string>"


def results(html: str | None, url: str | None) -> list[dict] | None:
    """Results of the site's own search; None where the page has no place for them."""
    tree = Tree(html)
    root, out = tree.first_of(RESULTS), []
    if root is None:
        return None
    for i in list(tree.select(RESULT_ROW, root)) or tree.select(RESULT_ROWS, root):
        link = tree.first_of(".mtitle > a[href]", i)
        link = tree.first_of("a[href]", i) if link is None else link
        title = "" if link is None else tree.text(link)
        if not title:
            continue
        body, date, unit, kind = tree.text(i), *(tree.first_of(s, i) for s in (RESULT_DATE, RESULT_UNIT, RESULT_KIND))
        told = _RESULT_DATE.search(body if date is None else tree.text(date))
        out.append({"title": title, "url": _resolved(url, tree.get(link, "href") or ""), "told": told[0] if told else None, "unit": None if unit is None else tree.text(unit), "category": None if kind is None else tree.text(kind), "body": body})
    return out


def search_results(pages: DataFrame, roots: list[str], unit: str) -> DataFrame:
    """(page_id, position, title, url, unit, category, published_at, body) of the results of search pages, those on allowed
    urls; a result that names no unit is of `unit`. A page without a place for results has one row of nulls."""

    @F.pandas_udf(f"array<{_RESULT}>")
    def run(htmls: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([results(h, u) for h, u in zip(htmls, own, strict=True)], dtype=object)

    ship(pages.sparkSession)
    found = pages.select("page_id", run("html", "url").alias("r"))
    rows = found.select("page_id", F.posexplode("r").alias("position", "x")).where(urls.is_allowed(F.col("x.url"), roots))
    rows = rows.select("page_id", F.col("position").cast("long").alias("position"), "x.title", "x.url", F.coalesce("x.unit", F.lit(unit)).alias("unit"), "x.category", text.parsed_date(F.col("x.told")).alias("published_at"), "x.body")
    return rows.unionByName(found.where("r is null").select("page_id"), allowMissingColumns=True)
