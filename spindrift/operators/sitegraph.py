"""Site pages and links: merges by precedence, frontier limits, candidate ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import folding, text, urls, vectors

#: How much a discovery source counts, and a page type.
SOURCES = {"official_unit": 100, "existing_document": 95, "existing_announcement": 95, "existing_source": 85, "configured_seed": 80, "manual": 60, "official_search": 50, "internal_link": 30}
TYPES = {"unit_homepage": 100, "announcement_listing": 90, "announcement_detail": 80, "official_document": 70, "general_page": 40, "search_result": 20, "unknown": 0}
#: Fixed: limits of the frontier.
PER_PAGE, PER_HOST, IN_ALL, DEPTH = 64, 128, 2000, 3
#: Fixed: thresholds and weights of candidate scores.
TITLE_FROM, PATH_FROM, ANCHOR_FROM, SIMILAR_FROM = 0.18, 0.22, 0.10, 0.3
CLOSED = ("blocked", "excluded")


def ranked(c: Column, table: dict[str, int]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(0)


#: The page types that say something.
SPECIFIC = ("unit_homepage", "announcement_listing", "announcement_detail", "official_document")


def page_defaults(incoming: DataFrame, now: int, delay_s: int = 0) -> DataFrame:
    """Rows of new pages (url, title, unit, content_hash, page_type, discovery_source, crawl_priority, minimum_depth, next_crawl_s, is_indexable) with what follows.

    Host and path come from the url; a page that may be indexed is discovered and active, another excluded; without a
    due time it is due after `delay_s`.
    """
    return incoming.select(
        "*",
        urls.host(F.col("url")).alias("host"),
        urls.path(F.col("url")).alias("path"),
        F.when(F.col("is_indexable"), "discovered").otherwise("excluded").alias("crawl_status"),
        F.col("is_indexable").alias("is_active"),
        F.lit(now).cast("long").alias("last_discovered_s"),
    ).withColumn("next_crawl_s", F.coalesce("next_crawl_s", F.lit(now + delay_s).cast("long")))


def merged_pages(current: DataFrame, incoming: DataFrame, now: int, delay_s: int = 0) -> DataFrame:
    """Next state by page_id: each column by its own rule.

    A title fills a gap; it replaces another if its source counts at least as much and the page was not fetched yet.
    Unit, hash and due time fill gaps; the source is the one that counts more; priority rises, depth falls; unknown
    types become any, general ones specific. Active follows a source that counts at least as much; so does indexable,
    which a weaker source can only take away.
    """
    new = page_defaults(incoming, now, delay_s)
    c, i = current.alias("c"), new.alias("i")
    old, comes = F.col("c.page_id").isNotNull(), F.col("i.page_id").isNotNull()
    a, b = ranked(F.col("c.discovery_source"), SOURCES), ranked(F.col("i.discovery_source"), SOURCES)
    fetched = F.col("c.crawl_status").isin("success", "unchanged")
    gap = F.coalesce("c.title", F.lit("")) == ""
    titled = F.col("i.title").isNotNull() & (gap | ~fetched & (b >= a))
    typed = (F.col("c.page_type") == "unknown") | (F.col("c.page_type") == "general_page") & F.col("i.page_type").isin(*SPECIFIC)

    def pick(name: str, takes, otherwise=None):
        kept = F.col(f"c.{name}") if otherwise is None else otherwise
        return F.when(~old, F.col(f"i.{name}")).when(~comes, F.col(f"c.{name}")).when(takes, F.col(f"i.{name}")).otherwise(kept).alias(name)

    fills = lambda name: pick(name, F.col(f"c.{name}").isNull())
    return c.join(i, F.col("c.page_id") == F.col("i.page_id"), "full_outer").select(
        F.coalesce("c.page_id", "i.page_id").alias("page_id"),
        pick("title", titled),
        fills("unit"),
        fills("content_hash"),
        pick("page_type", typed),
        pick("discovery_source", b > a),
        F.when(old, F.col("c.crawl_status")).otherwise(F.col("i.crawl_status")).alias("crawl_status"),
        F.greatest("c.crawl_priority", "i.crawl_priority").alias("crawl_priority"),
        F.least("c.minimum_depth", "i.minimum_depth").alias("minimum_depth"),
        fills("next_crawl_s"),
        pick("is_active", b >= a),
        pick("is_indexable", b >= a, F.col("c.is_indexable") & F.col("i.is_indexable")),
        F.when(old & comes, "updated").when(old, "kept").otherwise("created").alias("outcome"),
    )


def merged_links(rows: DataFrame) -> DataFrame:
    """One row for each (source, target): the first non-empty anchor, the first known type, the latest sight."""
    first = lambda value, given: F.min_by(value, F.when(given, F.col("position")))
    return rows.groupBy("source_page_id", "target_page_id").agg(
        F.coalesce(first("anchor_text", F.col("anchor_text") != ""), F.lit("")).alias("anchor_text"),
        F.coalesce(first("link_type", F.col("link_type") != "unknown"), F.lit("unknown")).alias("link_type"),
        F.max("seen_s").alias("last_seen_s"),
    )


def per_page(links: DataFrame, most: int = PER_PAGE) -> DataFrame:
    """The best links of each page by the type of their target, then position."""
    best = Window.partitionBy("source_page_id").orderBy(F.desc(ranked(F.col("page_type"), TYPES)), "position")
    return links.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).drop("_n")


def arrived(links: DataFrame) -> DataFrame:
    """(target, position): each target once, where the first link to it stands; links: (target, position)."""
    return links.groupBy("target").agg(F.min("position").alias("position"))


def frontier(arrivals: DataFrame, pending: DataFrame, host_most: int = PER_HOST, most: int = IN_ALL) -> DataFrame:
    """Targets whose links are kept, in order of arrival.

    arrivals: (position, host, known, is_indexable, ...), pending: (host, pending). Known targets and those that are no
    pages to fetch pass and take no room. Others must find room within their host's, then all hosts' limit of pending
    pages. Rows in excess of their host are gone before the total is counted, which equals taking them one by one. What
    fits in all is a top-k by position; only the pending total is read.
    """
    passes = F.col("known") | ~F.col("is_indexable")
    room = arrivals.where(~passes).join(pending, "host", "left").withColumn("_room", F.lit(host_most) - F.coalesce("pending", F.lit(0))).drop("pending")
    own = Window.partitionBy("host").orderBy("position")
    fits = room.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= F.col("_room")).drop("_n", "_room")
    left = most - (pending.agg(F.sum("pending")).first()[0] or 0)
    return arrivals.where(passes).unionByName(fits.orderBy("position").limit(max(0, left)))


def eligible(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("is_active") & F.col("is_indexable") & ~F.col("crawl_status").isin(*CLOSED))


#: Words by which a question asks for a kind of page, and what that kind then gains.
INTENTS = {
    "announcement": (("公告", "通知", "訊息", "最新消息"), {"announcement_listing": 0.34, "announcement_detail": 0.28}),
    "document": (("文件", "辦法", "表單", "規章", "申請表"), {"official_document": 0.34}),
    "homepage": (("首頁", "主頁", "home"), {"unit_homepage": 0.25}),
}


def weighted_terms(query: str, variants: list[str] = (), concepts: list[str] = ()) -> list[tuple[str, float]]:
    """The query, at most two variants of it and the concepts with their weights; what repeats, whatever its case, goes."""
    out, seen = [], set()
    for value, weight in [(query, 1.0), *((v, 0.85) for v in variants[:2]), *((c, 0.70) for c in concepts)]:
        key = " ".join(value.split()).casefold()
        if key and key not in seen:
            seen.add(key)
            out.append((value[:200], weight))
    return out


def candidates(pages: DataFrame, links: DataFrame, terms: list[tuple[str, float]], unit: str | None = None, hosts: tuple[str, ...] = (), limit: int = 20, homepage: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Pages by lexical likeness of title, path and incoming anchors to weighted terms, and by what they are.

    Terms are few and part of the plan, so pages and links are each read once and meet no table of terms. Each different
    text of an anchor is compared once. `allowed` hosts limit the pages; the terms' words tell what kind is asked for.
    """
    wanted = F.array(*[F.lit(w) for _, w in terms]) if terms else F.array().cast("array<double>")

    def likes(c: str) -> Column:
        """One likeness for each term."""
        return F.transform(F.array(text.trigrams(F.col(c))), lambda g: F.array(*[text.likeness_to(g, t) for t, _ in terms]))[0] if terms else F.array().cast("array<double>")

    best = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.zip_with(c, wanted, lambda x, w: x * w)), F.lit(0.0)))
    similar = lambda c, least: F.exists(c, lambda x: x >= max(least, SIMILAR_FROM))
    variants = list(dict.fromkeys(v for t, _ in terms for v in (t, "-".join(t.split()))))
    holds = lambda c: _any([F.ilike(c, F.lit(f"%{v}%")) for v in variants])
    scope = urls.in_scope(F.col("host"), allowed) if allowed is not None else F.lit(True)
    fine = eligible(pages).where(scope)
    # Exploded, likenesses are columns that filters after them use and do not take again.
    once = lambda **c: F.explode(F.array(F.struct(*[v.alias(k) for k, v in c.items()]))).alias("_s")
    anchors = links.select("anchor_text").distinct().select("anchor_text", once(l=likes("anchor_text"), h=holds(F.col("anchor_text"))))
    anchors = anchors.select("anchor_text", F.struct(best(F.col("_s.l")).alias("anchor"), similar(F.col("_s.l"), ANCHOR_FROM).alias("anchored"), F.col("_s.h").alias("h")).alias("s"))
    scored = links.select("target_page_id", "anchor_text").join(anchors.where("s.anchored or s.h"), "anchor_text")
    told = scored.groupBy(F.col("target_page_id").alias("page_id")).agg(F.max("s.anchor").alias("anchor"), F.bool_or("s.anchored").alias("anchored"))
    rows = fine.join(told, "page_id", "left").withColumn("linked", F.col("anchored").isNotNull()).withColumn("anchor", F.coalesce("anchor", F.lit(0.0))).withColumn("anchored", F.coalesce("anchored", F.lit(False)))
    rows = rows.select("*", once(title=likes("title"), path=likes("path"), in_title=holds(F.col("title")), in_path=holds(F.col("path")), in_unit=holds(F.col("unit"))))
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    s = lambda n: F.col(f"_s.{n}")
    lexical = F.least(F.lit(1.0), F.greatest(best(s("title")), best(s("path")), F.col("anchor")) * 0.65 + part(s("in_title"), 0.28) + part(s("in_path"), 0.12) + part(F.col("anchored"), 0.10) + part(s("in_unit"), 0.12))
    said = " ".join(t for t, _ in terms).casefold()
    kinds = {k: v for words, gains in INTENTS.values() if any(w in said for w in words) for k, v in gains.items()}
    kind = sum((part(F.col("page_type") == k, v) for k, v in kinds.items()), F.lit(0.0))
    structural = (
        part(F.col("unit") == F.lit(unit), 0.35)
        + part(F.col("host").isin(*hosts, ""), 0.25)
        + part(F.col("url") == F.lit(homepage), 0.25)
        + kind
        + F.least(F.col("crawl_priority"), F.lit(100)) / 1000.0
        + part(F.col("last_success_s").isNotNull(), 0.05)
        - F.least(F.col("failure_count"), F.lit(5)) * 0.04
    )
    found = similar(s("title"), TITLE_FROM) | similar(s("path"), PATH_FROM) | s("in_title") | s("in_path") | F.col("anchored") | F.col("linked") & s("in_unit") | F.col("page_type").isin("unit_homepage", "announcement_listing")
    measured = rows.select("page_id", "minimum_depth", "failure_count", "last_success_s", found.alias("_found"), F.round(lexical, 9).alias("lexical"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), structural)), 9).alias("structural")).where("_found")
    measured = measured.withColumn("final", F.round(F.col("lexical") * 0.75 + F.col("structural") * 0.25, 9))
    order = [F.desc("final"), F.desc("lexical"), F.desc("structural"), F.asc("minimum_depth"), F.asc("failure_count"), F.desc_nulls_last("last_success_s"), F.asc("page_id")]
    return measured.orderBy(*order).limit(limit).select("page_id", "lexical", "structural", "final", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return F.coalesce(out, F.lit(False))


#: Weights of a fetched page's features and the cost of its depth.
WEIGHTS = {"phrase": 0.16, "title": 0.14, "heading": 0.10, "anchor": 0.10, "url": 0.05, "body": 0.08, "lexical": 0.13, "semantic": 0.16, "parent": 0.10, "discovery": 0.05}
DEPTH_COST = 0.03
BODY_CHARS = 8_000


def _likeness(key: Column, queries: list[str]) -> Column:
    """The best likeness of a key to one of the queries, by character n-grams."""
    grams = text.key_ngrams(key)
    return F.greatest(F.lit(0.0), F.lit(0.0), *[text.jaccard(grams, text.key_ngrams(F.lit(folding.python_letters(q)))) for q in queries])


def _phrase(key: Column, queries: list[str]) -> Column:
    return _any([F.contains(key, F.lit(k)) for k in map(folding.python_letters, queries) if k]).cast("double")


def _covered(key: Column, concepts: list[str]) -> Column:
    """Share of all concepts that the key holds."""
    keys = [folding.python_letters(c) for c in concepts]
    return sum((F.contains(key, F.lit(k)).cast("int") for k in keys if k), F.lit(0)).cast("double") / max(1, len(keys))


def _weighed(values: dict[str, Column], depth: Column) -> Column:
    total = sum(WEIGHTS[k] for k in values)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((v * WEIGHTS[k] for k, v in values.items()), F.lit(0.0)) / total - depth * DEPTH_COST))


def _keyed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with the letters of each text as a column of its own, so that each is folded once."""
    return rows.select("*", *[folding.letters_key(F.coalesce(v, F.lit(""))).alias(f"_{k}") for k, v in columns.items()])


def candidate_scores(rows: DataFrame, queries: list[str], concepts: list[str]) -> DataFrame:
    """page_id and score of links to follow: rows (page_id, url, anchor_text, parent, discovery, depth)."""
    where = urls.decoded(urls.path(F.col("url")))
    k = _keyed(rows, {"anchor": F.col("anchor_text"), "url": where, "both": F.concat_ws(" ", F.coalesce("anchor_text", F.lit("")), where)})
    values = {
        "phrase": _phrase(F.col("_both"), queries),
        "anchor": F.greatest(_likeness(F.col("_anchor"), queries), _covered(F.col("_anchor"), concepts)),
        "url": F.greatest(_likeness(F.col("_url"), queries), _covered(F.col("_url"), concepts)),
        "parent": F.col("parent"),
        "discovery": F.col("discovery"),
    }
    return k.select("page_id", _weighed(values, F.col("depth")).alias("score"))


def page_scores(rows: DataFrame, queries: list[str], concepts: list[str], query_vector: Column | None = None) -> DataFrame:
    """page_id and score of fetched pages by ten features.

    rows: (page_id, url, title, headings, body, anchor_text, parent, discovery, depth, vector); of a body the first
    `BODY_CHARS` characters count; a vector that is null or of another length has no likeness.
    """
    body = F.substring("body", 1, BODY_CHARS)
    k = _keyed(rows, {"title": F.col("title"), "headings": F.array_join("headings", " "), "anchor": F.col("anchor_text"), "url": urls.decoded(urls.path(F.col("url"))), "body": body})
    both = lambda c: F.greatest(_likeness(F.col(c), queries), _covered(F.col(c), concepts))
    k = k.withColumn("_f", F.struct(both("_title").alias("title"), both("_headings").alias("heading"), both("_anchor").alias("anchor"), both("_url").alias("url")))
    f = lambda n: F.col(f"_f.{n}")
    values = {
        "phrase": F.greatest(*[_phrase(F.col(c), queries) for c in ("_title", "_headings", "_body")]),
        "title": f("title"),
        "heading": f("heading"),
        "anchor": f("anchor"),
        "url": f("url"),
        "body": _covered(F.col("_body"), concepts),
        "lexical": F.greatest(_likeness(F.col("_body"), queries), f("title"), f("heading"), f("anchor"), f("url")),
        "semantic": F.lit(0.0) if query_vector is None else vectors.cosine_clamped(F.col("vector"), query_vector),
        "parent": F.col("parent"),
        "discovery": F.col("discovery"),
    }
    return k.select("page_id", _weighed(values, F.col("depth")).alias("score"))


def page_order(scored: DataFrame, limit: int) -> DataFrame:
    """Found pages (page_id, score, published_day) in their final order: score, those with a day, latest day, all descending."""
    return scored.orderBy(F.desc("score"), F.desc(F.col("published_day").isNotNull()), F.desc("published_day"), "page_id").limit(limit)


def recorded_links(links: DataFrame, roots: list[str], hosts: list[str] | None = None, max_depth: int = DEPTH) -> DataFrame:
    """links (source_page_id, position, url, anchor_text, depth, listed) with target, type, depth and what becomes of each.

    outcome: max_depth for links of pages that lie too deep, policy for those the frontier refuses, duplicate for all but
    the first of a page's links to one target, else kept. A kept link has the first anchor that is not empty, with the
    type that comes with it; else the first type that is known.
    """
    t = urls.target(F.col("url"), roots, hosts, documents=True)
    too_deep = F.col("depth") >= max_depth
    rows = links.withColumn("anchor_text", F.trim(F.coalesce("anchor_text", F.lit("")))).withColumn("target", F.when(~too_deep, t))
    kind = F.when(F.col("listed"), "announcement").otherwise(urls.link_type(F.col("anchor_text"), F.col("target")))
    rows = rows.withColumn("link_type", kind)
    own = Window.partitionBy("source_page_id", "target")
    first = F.row_number().over(own.orderBy("position"))
    named, known = F.col("anchor_text") != "", F.col("link_type") != "unknown"
    best = lambda v, given: F.min_by(v, F.when(given, F.col("position"))).over(own)
    outcome = F.when(too_deep, "max_depth").when(F.col("target").isNull(), "policy").when(F.col("_n") > 1, "duplicate").otherwise("kept")
    return (
        rows.withColumn("_n", first)
        .withColumn("_anchor", F.coalesce(best("anchor_text", named), F.lit("")))
        .withColumn("_type", F.coalesce(best("link_type", named), best("link_type", known), F.lit("unknown")))
        .select(
            "source_page_id",
            "position",
            "target",
            F.col("_anchor").alias("anchor_text"),
            F.col("_type").alias("link_type"),
            F.when(F.col("listed"), "announcement_detail").when(urls.is_document(F.col("target")), "official_document").otherwise("unknown").alias("page_type"),
            (F.greatest("depth", F.lit(0)) + 1).alias("minimum_depth"),
            (~urls.is_document(F.col("target"))).alias("is_indexable"),
            outcome.alias("outcome"),
        )
    )


def link_outcomes(recorded: DataFrame) -> DataFrame:
    """How many links there are of each type and outcome."""
    return recorded.groupBy(F.col("link_type").alias("category"), F.col("outcome").alias("reason")).agg(F.count("*").alias("links"))
