"""What becomes of fetched pages: outcomes, ingestion states, imports; a cache whose entries expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = ("announcement_listing", "announcement_detail")


def outcome(status: Column, content_type: Column, fetched_hash: Column, known_hash: Column, failed: Column) -> Column:
    """unchanged, failed, skipped, changed or ingestion_failed, by the first rule that holds."""
    return (
        F.when(status == 304, "unchanged")
        .when(status.isNull() | (status != 200), "failed")
        .when(~F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html")), "skipped")
        .when(F.coalesce(failed, F.lit(False)), "ingestion_failed")
        .when(fetched_hash.eqNullSafe(known_hash), "unchanged")
        .otherwise("changed")
    )


def after_fetch(pages: DataFrame, fetched: DataFrame, now: int) -> DataFrame:
    """Pages with hash, status and times after a fetch (page_id, new_hash, new_title): failures start again at zero."""
    hit = F.col("new_hash").isNotNull()
    changed = hit & ~F.col("new_hash").eqNullSafe(F.col("content_hash"))
    return pages.join(fetched, "page_id", "left").select(
        "page_id",
        F.when(hit, F.coalesce("new_title", "title")).otherwise(F.col("title")).alias("title"),
        F.when(hit, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(changed, "success").when(hit, "unchanged").otherwise(F.col("crawl_status")).alias("crawl_status"),
        F.when(hit, 0).otherwise(F.col("failure_count")).cast("int").alias("failure_count"),
        F.when(hit, F.lit(now)).otherwise(F.col("last_success_s")).cast("long").alias("last_success_s"),
    )


def needed(page_type: Column, state: Column, list_state: Column, ingested_hash: Column, fetched_hash: Column, saved: Column) -> Column:
    """Whether a page has to be taken in: list pages by both states and hash, others by their state, all if not saved."""
    lists = ~state.isin("success", "partial") | ~list_state.isin("success", "incomplete") | ~ingested_hash.eqNullSafe(fetched_hash)
    return F.coalesce(F.when(page_type.isin(*LISTS), lists).otherwise(state != "success"), F.lit(True)) | ~F.coalesce(saved, F.lit(False))


def advanced(state: Column, event: Column) -> Column:
    """The ingestion state after begin, complete, partial or fail; other events, and results of what never began, change nothing."""
    running = state == "running"
    return F.when(event == "begin", "running").when(running & (event == "complete"), "success").when(running & (event == "partial"), "partial").when(running & (event == "fail"), "failed").otherwise(state)


def imported(parts: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """(canonical_url, discovery_source, title) of all urls of several tables, each by the source that counts most."""
    rows = None
    for name, weight, df in parts:
        one = df.select("canonical_url", F.lit(name).alias("discovery_source"), F.lit(weight).alias("_w"), "title")
        rows = one if rows is None else rows.unionByName(one)
    best = F.max_by(F.struct("discovery_source", "title"), F.struct("_w", "title"))
    return rows.groupBy("canonical_url").agg(best.alias("b")).select("canonical_url", "b.*")


def cache_key(parts: list[Column]) -> Column:
    return F.sha2(F.to_json(F.struct(*[c.alias(f"p{i}") for i, c in enumerate(parts)])).cast("binary"), 256)


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache (cache_key, payload, written_s, expires_s) after entries of the same columns: the latest of a key wins."""
    both = cache.unionByName(entries)
    best = F.max_by(F.struct(*both.columns), F.struct("written_s", "payload"))
    return both.groupBy("cache_key").agg(best.alias("b")).select("b.*")


def cache_get(cache: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """(cache_key, payload, seconds_left) of the keys whose entry has not expired."""
    return cache.where(F.col("expires_s") > now).join(keys, "cache_key", "left_semi").select("cache_key", "payload", (F.col("expires_s") - now).alias("seconds_left"))
