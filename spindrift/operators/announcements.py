"""Announcement lists: filters, orders, pages, de-duplication, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import folding, text, urls

LEAST_RELEVANCE = 0.1
OVERFETCH, MOST = 3, 20


def selected(rows: DataFrame, query: str | None = None, unit: str | None = None, day_from: int | None = None, day_to: int | None = None, snapshot: DataFrame | None = None, hidden: str = "fixture") -> DataFrame:
    """Rows by date range, and by unit, query and public source; a snapshot list of urls replaces those three.

    An empty snapshot selects nothing. With a query each row has its relevance.
    """
    if day_from is not None and day_to is not None and day_from > day_to:
        raise ValueError("the range ends before it begins")
    out = rows
    if day_from is not None:
        out = out.where(F.col("published_day") >= day_from)
    if day_to is not None:
        out = out.where(F.col("published_day") <= day_to)
    relevance = F.greatest(*[text.likeness_to(text.trigrams(F.col(c)), query) for c in ("title", "body")]) if query else F.lit(0.0)
    out = out.withColumn("relevance", F.round(relevance, 9))
    if snapshot is not None:
        return out.join(snapshot.select("canonical_url", "position"), "canonical_url")
    out = out.where(~F.ilike("source", F.lit(f"%{hidden}%")))
    if unit:
        out = out.where(F.ilike("unit", F.lit(f"%{unit}%")))
    return out.where(F.col("relevance") >= LEAST_RELEVANCE) if query else out


def ordered(rows: DataFrame, sort: str, limit: int, snapshot: bool = False) -> DataFrame:
    """newest, oldest or relevance; a snapshot breaks ties by its own order. The rank is in the result."""
    tail = [F.col("position")] if snapshot else [F.desc("last_crawled_s")]
    keys = {"newest": [F.desc("published_day"), *tail], "oldest": [F.asc("published_day"), *tail], "relevance": [F.desc("relevance"), F.desc("published_day"), *tail]}[sort]
    order = [*keys, F.asc("id")]
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def matching(rows: DataFrame, q: str | None = None, unit: str | None = None) -> DataFrame:
    """Rows whose title or body is like the query, of one unit exactly."""
    out = rows
    if q:
        out = out.where(F.ilike("title", F.lit(f"%{q}%")) | F.ilike("body", F.lit(f"%{q}%")))
    return out.where(F.col("unit") == unit) if unit else out


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    return rows.orderBy(F.desc("published_day"), F.desc("id")).offset((number - 1) * size).limit(size)


def identity(title: Column, day: Column, unit: Column) -> Column:
    """Title, day and unit, whatever the width, case and white space of their letters."""
    fold = lambda c: folding.query_key(F.coalesce(c, F.lit("")))
    return F.concat_ws("|", fold(title), day.cast("string"), fold(unit))


def without_repeats(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of the best rows of which none repeats the url identity or the title identity of one kept before.

    A dropped row claims nothing, so the rows are folded in order; they are few, as only `MOST` are fetched.
    """
    fetched = rows.orderBy("rank").limit(min(MOST, limit * OVERFETCH))
    keyed = fetched.select("rank", F.struct("*").alias("row"), urls.content_identity(F.col("canonical_url")).alias("u"), identity(F.col("title"), F.col("published_day"), F.col("unit")).alias("t"))
    inOrder = F.array_sort(F.collect_list(F.struct("rank", "u", "t", "row")))
    listed = keyed.agg(inOrder.alias("all"))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: (k["u"] == x["u"]) | (k["t"] == x["t"])), kept).otherwise(F.concat(kept, F.array(x)))
    kept = listed.select(F.aggregate("all", F.slice("all", 1, 0), step).alias("kept"))
    return kept.select(F.inline(F.slice("kept", 1, limit))).select("row.*")


def merged(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next state by url, and what became of each incoming row: created, updated or unchanged.

    An incoming row may say in `completeness` how many characters of a body it got; where the stored body has more, the
    row is weaker and changes nothing but the time of the last crawl. All others replace title, day, body and warning,
    nulls included; the row is unchanged if title and body hash to what they did.
    """
    c, i = current.alias("c"), incoming.alias("i")
    there, comes = F.col("c.canonical_url").isNotNull(), F.col("i.canonical_url").isNotNull()
    weaker = F.coalesce(there & comes & (F.length(F.trim("c.body")) > F.col("i.completeness")), F.lit(False))
    stays = weaker | ~comes
    pick = lambda n: F.when(stays, F.col(f"c.{n}")).otherwise(F.col(f"i.{n}")).alias(n)
    digest = lambda r: text.content_hash(F.concat(F.col(f"{r}.title"), F.lit("\n"), F.col(f"{r}.body")))
    outcome = F.when(~comes, F.lit(None).cast("string")).when(~there, "created").when(weaker | digest("i").eqNullSafe(digest("c")), "unchanged").otherwise("updated")
    return c.join(i, F.col("c.canonical_url") == F.col("i.canonical_url"), "full_outer").select(
        F.coalesce("i.canonical_url", "c.canonical_url").alias("canonical_url"), pick("title"), pick("published_day"), pick("body"), pick("warning"), F.coalesce("i.last_crawled_s", "c.last_crawled_s").alias("last_crawled_s"), outcome.alias("outcome")
    )


def with_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """One row for each url that a list or a detail page names: what the detail says, else what the list does.

    listings, details: (canonical_url, title, published_day, body), one row a url. Rows that no side dates are undated.
    """
    a, b = listings.alias("a"), details.alias("b")
    pick = lambda n: F.coalesce(F.col(f"b.{n}"), F.col(f"a.{n}")).alias(n)
    return a.join(b, F.col("a.canonical_url") == F.col("b.canonical_url"), "full_outer").select(*[pick(n) for n in ("canonical_url", "title", "published_day", "body")]).withColumn("undated", F.col("published_day").isNull())


def snapshot_commit(sources: DataFrame, observed: DataFrame) -> DataFrame:
    """Per source the ordered distinct urls of its latest crawl, unless that is older than what is there.

    observed: (name, canonical_url, position, crawled_s).
    """
    newest = observed.groupBy("name").agg(F.max("crawled_s").alias("crawled_s"))
    urls_of = observed.join(newest, ["name", "crawled_s"]).groupBy("name", "crawled_s", "canonical_url").agg(F.min("position").alias("position"))
    lists = urls_of.groupBy("name", "crawled_s").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "canonical_url"))), lambda x: x["canonical_url"]).alias("urls"))
    # A refused list leaves the stored one, where there is a column for it.
    stored = F.col("canonical_urls") if "canonical_urls" in sources.columns else F.lit(None).cast("array<string>")
    taken = F.col("crawled_s").isNotNull() & (F.col("last_success_s").isNull() | (F.col("crawled_s") >= F.col("last_success_s")))
    return sources.join(lists, "name", "left").select("name", F.when(taken, F.col("crawled_s")).otherwise(F.col("last_success_s")).alias("last_success_s"), F.when(taken, F.col("urls")).otherwise(stored).alias("urls"))


def due_sources(sources: DataFrame, now: int) -> DataFrame:
    """Sources never crawled, or not within their interval."""
    return sources.where(F.col("last_success_s").isNull() | (F.lit(now) - F.col("last_success_s") >= F.col("interval_minutes") * 60))
