"""What fetched pages leave behind, as one change of three tables: states of pages, the link graph, and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import urls
from spindrift.operators import attempts, crawling, sitegraph
from spindrift.sources.sinks import Tables

#: Fixed: seconds until a page that was found is due.
NEW_AFTER_S = 30
#: Columns of the table of pages.
PAGE = ("page_id", "url", "title", "unit", "content_hash", "page_type", "discovery_source", "crawl_priority", "minimum_depth", "is_indexable", *attempts.STATE)


def persisted(pages: DataFrame, links: DataFrame, log: DataFrame, reports: DataFrame, found: DataFrame, now: int, roots: list[str], per_page: int = sitegraph.PER_PAGE, per_host: int = sitegraph.PER_HOST, most: int = sitegraph.IN_ALL) -> dict[str, DataFrame]:
    """The next pages, links and attempts after reports of fetched pages.

    pages: `PAGE`; links: (source_page_id, target_page_id, anchor_text, link_type, position, seen_s); log: rows of attempts
    since the state in `pages`; reports: rows of the log with title and content_hash; found: (source_page_id, token,
    position, url, anchor_text, depth, listed), the links of each report.

    A report counts only with the owner and token of a live lease; then the page has its new state, title and hash, and of
    its links those the frontier follows, at most `per_page`, are kept. New targets must find room within the pending
    pages of their host and of all, as they are after the reports; known ones and documents need none. Targets become
    pages or are found again, links are merged, and what a worker without the lease says leaves nothing but its attempt.
    """
    c = F.col
    replay = attempts.replayed(log.select(*attempts.LOG).unionByName(reports.select(*attempts.LOG)), pages)
    good = replay.where("accepted and event = 'complete'").select("page_id", "token", "at_s", "seq")
    told = reports.join(good, ["page_id", "token", "at_s", "seq"], "left_semi").groupBy("page_id").agg(F.max_by(F.struct("title", "content_hash"), F.struct("at_s", "seq")).alias("_r"))
    state = attempts.states(replay, pages)
    after = pages.drop(*attempts.STATE).join(state, "page_id").join(told, "page_id", "left")
    after = after.withColumn("title", F.coalesce("_r.title", "title")).withColumn("content_hash", F.coalesce("_r.content_hash", "content_hash")).select(*PAGE)

    own = found.join(good.select(c("page_id").alias("source_page_id"), "token"), ["source_page_id", "token"], "left_semi")
    kept = sitegraph.per_page(sitegraph.recorded_links(own, roots).where("outcome = 'kept'"), per_page)
    known = after.select(c("url").alias("target"), c("page_id").alias("target_page_id"))
    targets = kept.groupBy("target").agg(F.min("position").alias("position"), F.min_by("page_type", "position").alias("page_type"), F.min("minimum_depth").alias("minimum_depth"), F.max("is_indexable").alias("is_indexable"))
    targets = targets.join(known, "target", "left").withColumn("known", c("target_page_id").isNotNull()).withColumn("host", urls.host(c("target"))).withColumn("target_page_id", F.coalesce("target_page_id", F.xxhash64("target")))
    waiting = crawling.waiting(after).groupBy(urls.host(c("url")).alias("host")).agg(F.count("*").alias("pending"))
    room = sitegraph.frontier(targets, waiting, per_host, most)

    text = F.lit(None).cast("string")
    incoming = room.select(c("target_page_id").alias("page_id"), c("target").alias("url"), text.alias("title"), text.alias("unit"), text.alias("content_hash"), "page_type", F.lit("internal_link").alias("discovery_source"), F.lit(0).alias("crawl_priority"), "minimum_depth", F.lit(None).cast("long").alias("next_crawl_s"), "is_indexable")
    merged = sitegraph.merged_pages(after, incoming, now, NEW_AFTER_S)
    rest = [n for n in PAGE if n not in merged.columns]
    merged = merged.join(after.select("page_id", *rest), "page_id", "left").join(incoming.select("page_id", c("url").alias("_url")), "page_id", "left").withColumn("url", F.coalesce("url", "_url"))
    zero = {n: F.coalesce(n, F.lit(0)) for n in ("failure_count", "changed_streak", "unchanged_streak")}
    edges = kept.join(room.select("target", "target_page_id"), "target").select("source_page_id", "target_page_id", "anchor_text", "link_type", "position", F.lit(now).cast("long").alias("seen_s"))
    # What was there keeps its place before what is seen again.
    both = links.select(*edges.columns[:4], (c("position") - (1 << 40)).alias("position"), "seen_s").unionByName(edges)
    graph = sitegraph.merged_links(both).join(both.groupBy("source_page_id", "target_page_id").agg(F.min("position").alias("position")), ["source_page_id", "target_page_id"])
    graph = graph.select("source_page_id", "target_page_id", "anchor_text", "link_type", F.when(c("position") < 0, c("position") + (1 << 40)).otherwise(c("position")).alias("position"), c("last_seen_s").alias("seen_s"))
    return {"pages": merged.withColumns(zero).select(*PAGE), "links": graph, "attempts": attempts.attempts(replay)}


def commit(tables: Tables, began: int, log: DataFrame, reports: DataFrame, found: DataFrame, now: int, roots: list[str], **limits: int) -> int:
    """Publish `persisted` over the tables as they were at version `began`, all of it or, for a late writer, nothing."""
    pages, links = (tables.read(n, began) for n in ("pages", "links"))
    return tables.commit(persisted(pages, links, log, reports, found, now, roots, **limits), began)
