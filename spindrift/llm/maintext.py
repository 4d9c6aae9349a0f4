"""Main text of HTML pages: a page is cut into flat blocks of text; a decision tree tells from a block's words and link
density, those of the blocks before and behind it, and the marks around it whether it belongs to the article.

The tree is trained here, on a small labelled table of blocks: the parts of `PARTS`, put together to pages by rule.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import shipped
from spindrift.sources.markup import END, START, VOID, attributes, closes_itself, events

#: Fixed: elements that begin and end a block; elements without text of the page; elements around what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template svg iframe object title textarea select datalist button canvas audio video noframes noembed map".split())
AROUND = frozenset("nav aside footer form dialog menu search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
#: Fixed: words of class, id and label that say so, those that also say so of an article itself, and those of a page's head.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr privacy notice notification notifications alert popup modal overlay "
    "comment comments commentlist disqus reply replies respond discussion sidebar sidebars menu submenu nav navbar navigation breadcrumb breadcrumbs pagination pager footer copyright colophon share sharing social related recommended "
    "newsletter subscribe subscription signup login widget widgets toolbar skip search form masthead topbar outbrain taboola teaser teasers trending".split()
)
OF_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment reply related recommended teaser".split())
OF_HEADS = frozenset({"header", "masthead", "banner", "topbar"})
CONTENT = frozenset("article articlebody content post entry story main maincontent text body".split())
#: Fixed: headings above what is not the article.
TITLES = frozenset(
    "comments|comment|reader comments|readers' comments|leave a comment|leave a reply|related|related articles|related posts|related links|related stories|you may also like|read more|more stories|share|share this|share this article|advertisement|newsletter|kommentare|leserkommentare|ähnliche artikel|mehr zum thema|commentaires|articles similaires|à lire aussi|comentarios|artículos relacionados|留言|相關文章".split("|")
)

_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: A line that claims rights; within an article it is the article's.
_LEGAL = re.compile(r"^(©|\(c\)\s|copyright\s+(©|\(c\)|\d{4}))|all rights reserved\W*$", re.I)
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힯]")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_behind", "link_density_behind", "around", "hinted", "place", "heading", "paragraph"]


def tokens(text: str) -> set[str]:
    return {t.lower() for t in _TOKEN.findall(text)}


def _count(text: str) -> int:
    """Words; two characters of scripts that part no words count as one."""
    n = len(text.split())
    return n if text.isascii() else n + len(_WIDE.findall(text)) // 2


class Element:
    """An open element, with what it and those around it say of the text inside."""

    __slots__ = ("around", "hinted", "in_article", "inside", "named", "tag", "titled")

    def __init__(self, tag: str = "", up: Element | None = None, attrs: str = ""):
        self.tag, self.titled = tag, 0
        if up is None:
            self.around = self.hinted = self.in_article = self.inside = self.named = False
            return
        a = attributes(attrs) if attrs else {}
        own = tag in ("article", "main") or a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody"
        words = tokens(f"{a.get('class', '')} {a.get('id', '')} {a.get('aria-label', '')}") if a and tag not in ("html", "body", "main") else set()
        if own:
            words &= OF_ARTICLES
        head = tag == "header" or bool(words & OF_HEADS)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        self.in_article = up.in_article or tag == "article"
        self.inside = up.inside or own
        self.named = up.named or bool(words & CONTENT) and not words & HINTS
        # An article within an article is a comment or a hint at another one.
        self.around = up.around or hidden or tag in AROUND or a.get("role") in ROLES or (tag == "article" and up.in_article) or (head and not up.inside and not up.named)
        self.hinted = up.hinted or up.titled > 0 or bool(words & (HINTS - OF_HEADS))


class Block:
    __slots__ = ("element", "hinted", "linked", "text", "words")

    def __init__(self, text: str, links: str, element: Element):
        self.text, self.words, self.element = text, _count(text), element
        self.linked = min(1.0, _count(links) / max(1, self.words)) if links else 0.0
        self.hinted = element.hinted or element.titled > 0


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page that hold text, in page order; white space is one space. Linear in the page."""
    out: list[Block] = []
    stack, open_tags, parts, links = [Element()], {}, [], []
    silent, link = "", 0

    def flush():
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            top = stack[-1]
            level = int(top.tag[1]) if len(top.tag) == 2 and top.tag[0] == "h" and top.tag[1].isdigit() else 0
            if level:
                above = stack[-2]
                if re.sub(r"^[\d\s(]+|[\s\d():：]+$", "", text.lower()) in TITLES:
                    above.titled, top.titled = level, level
                elif above.titled >= level:
                    above.titled = top.titled = 0
                    top.hinted = above.hinted
            out.append(Block(text, " ".join(links), top))
        parts.clear(), links.clear()

    def close():
        gone = stack.pop()
        open_tags[gone.tag] -= 1

    for kind, tag, rest in events(html):
        if kind == START:
            if silent:
                continue
            if tag in SILENT:
                silent = "" if closes_itself(rest) else tag
            elif tag == "br":
                parts.append(" ")
            elif tag in BLOCKS or tag == "hr":
                flush()
                if stack[-1].tag == "p":
                    close()
                for over in _CLOSES.get(tag, ()):
                    if stack[-1].tag == over:
                        close()
                if tag not in VOID:
                    stack.append(Element(tag, stack[-1], rest))
                    open_tags[tag] = open_tags.get(tag, 0) + 1
            elif tag == "a":
                link = len(stack) if "href" in rest.lower() else 0
        elif kind == END:
            if silent and (tag == silent or open_tags.get(tag)):
                silent = ""
                if tag in SILENT:
                    continue
            if silent:
                continue
            if tag == "a":
                link = 0
            elif tag in BLOCKS:
                flush()
                if open_tags.get(tag):
                    while stack[-1].tag != tag:
                        close()
                    close()
                    if len(stack) < link:
                        link = 0
        elif not silent:
            parts.append(tag)
            if link:
                links.append(tag)
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """(blocks, FEATURES)"""
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    whole = any(b.element.inside for b in found)
    for i, b in enumerate(found):
        e = b.element
        place = 2 if e.inside or (e.named and not whole) else 0 if whole else 1  # in what is marked as the article, outside of it, or nothing is
        out[i] = b.words, b.linked, 0, 0, 0, 0, e.around, b.hinted or (place < 2 and _LEGAL.search(b.text) is not None), place, e.tag[:1] == "h" and e.tag[1:].isdigit(), e.tag == "p"
    out[1:, 2:4] = out[:-1, 0:2]
    out[:-1, 4:6] = out[1:, 0:2]
    return out


class Tree:
    """A decision tree of yes and no, grown by the largest fall of the Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 4):
        self.feature, self.limit, self.below, self.share = [], [], [], []
        self._grow(x, y.astype(float), depth, least)

    def _grow(self, x, y, depth, least) -> int:
        at = len(self.feature)
        for column, value in ((self.feature, -1), (self.limit, 0.0), (self.below, (0, 0)), (self.share, float(y.mean()) if len(y) else 0.0)):
            column.append(value)
        best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0) if len(y) else (0.0, -1, 0.0)
        for f in range(x.shape[1] if depth and len(y) >= 2 * least else 0):
            order = np.argsort(x[:, f], kind="stable")
            v, yes = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = yes[:-1] / n, (yes[-1] - yes[:-1]) / (len(y) - n)
            cost = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
            cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            self.feature[at], self.limit[at] = best[1], best[2]
            self.below[at] = self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of labelled rows in each row's leaf that belong to the article."""
        at = np.zeros(len(x), int)
        feature, limit, below = np.array(self.feature), np.array(self.limit), np.array(self.below).reshape(-1, 2)
        while len(x) and (feature[at] >= 0).any():
            inner = feature[at] >= 0
            side = x[np.arange(len(x)), np.maximum(feature[at], 0)] > limit[at]
            at = np.where(inner, below[at, side.astype(int)], at)
        return np.array(self.share)[at]


#: The labelled table: parts of pages, `+` for blocks of the article and `-` for others; `{+3-12}` are 3 to 12 words.
L = '<a href="x">'
PARTS = {
    "article": [
        "<p>{+15-120}</p>", "<p>{+15-120}</p>", "<p>{+15-120}</p>", "<p>{+1-12}</p>", "<p>{+1-5}</p>", "<h2>{+1-8}</h2>", "<h3>" + L + "{+1-8}</a></h3>", "<ul><li>{+1-15}</li><li>{+1-15}</li><li>{+1-15}</li></ul>",
        "<blockquote><p>{+8-40}</p></blockquote>", "<pre>{+3-30}</pre>", "<figure><figcaption>{+3-15}</figcaption></figure>", "<table><tr><td>{+1-4}</td><td>{+1-4}</td></tr></table>",
        "<p>{+10-40} " + L + "{1-6}</a> {8-20}</p>", "<p>" + L + "{+1-4}</a> {3-9}</p>", "<div>{+10-80}</div>", "<section><h2>{+1-8}</h2><p>{+15-120}</p></section>", "<dl><dt>{+1-3}</dt><dd>{+2-20}</dd></dl>",
    ],
    "within": [
        '<div class="ad">{-3-60}</div>', "<aside><p>{-5-60}</p></aside>", '<div class="share-buttons">' + f"{L}{{-1-1}}</a> {L}{{1-1}}</a></div>", '<form action="x"><p>{-2-30}</p></form>', "<footer><p>{-3-15}</p></footer>",
        "<ul>" + f"<li>{L}{{-2-9}}</a></li>" * 4 + "</ul>", '<section id="comments"><h2>{-1-2}</h2><div class="comment"><p>{-5-90}</p><p>{-1-30}</p></div></section>', f"<p>{L}{{-1-3}}</a> {L}{{1-3}}</a> {L}{{1-3}}</a></p>",
        "<h2>Comments</h2><p>{-5-90}</p><p>{-1-20}</p>", "<nav>" + f"{L}{{-1-3}}</a> " * 3 + "</nav>", '<div class="sidebar"><p>{-5-80}</p></div>',
    ],
    "outside": [
        "<nav><ul>" + f"<li>{L}{{-1-3}}</a></li>" * 5 + "</ul></nav>", "<div>" + f"{L}{{-1-3}}</a> | " * 5 + "</div>", "<header><h1>{-1-5}</h1><p>{-2-9}</p></header>", '<div class="cookie-notice"><p>{-8-60}</p></div>', '<div class="ad">{-3-60}</div>',
        '<div id="sidebar"><h3>{-1-3}</h3><p>{-5-80}</p></div>', "<aside><h3>{-1-3}</h3><p>{-5-80}</p></aside>", f'<div class="breadcrumbs">{L}{{-1-2}}</a> {L}{{1-2}}</a> {{1-5}}</div>', '<form action="x"><p>{-2-30}</p></form>', "<ul>" + f"<li>{L}{{-2-9}}</a></li>" * 5 + "</ul>",
        "<div>{-1-3}</div>", "<footer><p>{-3-40}</p><p>{-3-12}</p></footer>", '<div class="footer">{-3-40}</div>', '<section class="comments"><h2>{-1-2}</h2><p>{-5-90}</p><p>{-1-30}</p></section>', '<div class="related">' + f"<p>{L}{{-3-9}}</a></p>" * 3 + "</div>",
        f"<table><tr><td>{L}{{-1-3}}</a></td><td>{L}{{-1-3}}</a></td></tr></table>", "<div>{-2-9} " + f"{L}{{2-4}}</a></div>",
    ],
    "frame": ["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="post-body">{}</div>', "<div>{}</div>", "{}"],
}
#: Pages of the labelled table.
PAGES = 1_000


def labelled_pages(pages: int = PAGES, seed: int = 13) -> list[str]:
    """Pages of parts; the first word of every block is its label. The same for the same seed."""
    rng = random.Random(seed)

    def said(part: str) -> str:
        return re.sub(r"\{([+-]?)(\d+)-(\d+)\}", lambda m: (m[1] + " " if m[1] else "") + " ".join(["word"] * rng.randint(int(m[2]), int(m[3]))), part)

    def some(kind: str, low: int, high: int) -> list[str]:
        return [said(rng.choice(PARTS[kind])) for _ in range(rng.randint(low, high))]

    out = []
    for i in range(pages):
        frame = PARTS["frame"][i % len(PARTS["frame"])]
        body = [*[said("<h1>{+2-14}</h1>")] * (rng.random() < 0.7), *some("article", 1, 9)]
        if frame in ("{}", "<div>{}</div>"):  # without a mark of its own, an article is known by a long paragraph
            body.insert(len(body) > 1, said("<p>{+25-120}</p>"))
        if rng.random() < 0.3:
            body.append(said("<p>{+1-4}</p>"))
        for noise in some("within", 0, 2):
            if "<h2>Comments</h2>" in noise:
                body.append(noise)
            else:
                body.insert(rng.randint(1, len(body)), noise)
        out.append("<html><body>" + "".join(some("outside", 0, 4) if rng.random() < 0.8 else []) + frame.replace("{}", "".join(body)) + "".join(some("outside", 0, 4)) + "</body></html>")
    return out


def labelled_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, label) of the blocks of labelled pages; blocks that carry no label are left out."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        marked = [b.text[:1] in "+-" for b in found]
        x.append(features(found)[marked])
        y += [b.text[0] == "+" for b, m in zip(found, marked, strict=True) if m]
    return np.concatenate(x), np.array(y, float)


@cache
def tree() -> Tree:
    x, y = labelled_rows(labelled_pages())
    x[:, 0] -= 1  # the label is no word
    x[1:, 2] -= 1
    x[:-1, 4] -= 1
    return Tree(np.maximum(x, 0), y)


def main_text(html: str | None, model: Tree | None = None) -> str:
    """The article's blocks, joined by line feeds; empty if there are none."""
    found = blocks(html)
    if not found:
        return ""
    kept = (model or tree()).predict(features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of `pages` (page_id, url, html)."""
    model = tree()

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = [main_text(h.as_py(), model) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return shipped(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op13(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    A null or empty html, and one without an article, gives an empty text. A line break inside a block is white space.
    A page is read whole, whatever its length, and broken mark-up as far as it says something; nulls in page_id and url
    stay; rows that repeat repeat; an empty table gives an empty result; other columns are ignored.
    """
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))
