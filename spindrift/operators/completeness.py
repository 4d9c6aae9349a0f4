"""Whether stored evidence answers a question: counters over current documents and announcements, then ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import schedule

#: Fixed: freshness windows in seconds.
DOC_SOFT, DOC_HARD = 360 * 60, 1440 * 60
ANN_SOFT, ANN_HARD = 90 * 60, 360 * 60
#: Fixed: limits of the decision.
LEAST_COVERAGE, LEAST_STRONG, LEAST_MARGIN, SCOPED_SCORE, LEAST_SECONDS = 0.60, 2, 0.04, 0.82, 2.0
STRONG_SCORE, STRONG_CHARS = 0.58, 160

TOPICS, LISTS = ("topic", "scoped_topic"), ("announcement", "keyword_announcement", "latest")


def _counters(now: int, age: Column, soft: int, hard: int) -> list[Column]:
    """Freshness of rows by age, and those under a live lease of crawl or ingestion."""
    fresh = schedule.freshness(age, soft, hard)
    live = lambda c: F.coalesce(F.col(c) > now, F.lit(False))
    return [
        F.count_if(fresh == "fresh").alias("fresh"),
        F.count_if(fresh == "soft_stale").alias("soft_stale"),
        F.count_if(fresh == "hard_stale").alias("hard_stale"),
        F.count_if(live("lease_expires_s") | live("ingestion_lease_expires_s")).alias("active_refresh"),
    ]


#: Columns of pages that facts are made of.
PAGE = ("canonical_url", "page_type", "last_success_s", "content_hash", "ingestion_content_hash", "ingestion_status", "announcement_ingestion_status", "lease_expires_s", "ingestion_lease_expires_s")
#: Ingestion states of a failure, and of announcements whose lists are in step.
FAILED, IN_STEP, LISTED = ("failed", "partial"), ("success", "partial"), ("success", "incomplete", "not_applicable")


def document_facts(docs: DataFrame, pages: DataFrame, now: int, key: str = "unit") -> DataFrame:
    """Per key the counters over the first current document of each url, joined to its page where there is one; documents
    that are not current are only counted as superseded.

    docs: (key, canonical_url, doc_id, is_current, unit, scope_unit), pages: `PAGE`, one row a url. A document without a
    page is hard stale and nothing else; all current ones being homepages, or lists, counts them once more.
    """
    c = F.col
    first = Window.partitionBy(key, "canonical_url").orderBy(F.desc("is_current"), "doc_id")
    rows = docs.select(key, "canonical_url", "doc_id", c("is_current"), (c("unit") == c("scope_unit")).alias("_exact")).withColumn("_n", F.row_number().over(first))
    rows = rows.join(pages.select(*PAGE), "canonical_url", "left")
    one = c("is_current") & (c("_n") == 1)
    of = lambda condition, name: F.count_if(one & condition).alias(name)
    counted = rows.groupBy(key).agg(
        F.count_if(one).alias("documents"),
        F.count_if(~c("is_current")).alias("superseded"),
        of(c("page_type").isNotNull(), "with_page"),
        of(c("_exact"), "exact_scope"),
        of(c("page_type") == "unit_homepage", "_home"),
        of(c("page_type") == "announcement_listing", "_list"),
        of((c("content_hash") != "") & (c("content_hash") == c("ingestion_content_hash")), "in_sync"),
        of(c("ingestion_status") == "pending", "pending"),
        of(c("ingestion_status").isin(*FAILED), "failed"),
        of(c("announcement_ingestion_status") == "incomplete", "incomplete"),
    )
    ages = rows.where(one).groupBy(key).agg(*_counters(now, F.lit(now) - c("last_success_s"), DOC_SOFT, DOC_HARD))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    every = lambda n: F.when(c(n) == c("documents"), c(n)).otherwise(0).cast("long")
    return counted.join(ages, key, "left").select(
        key, "documents", "superseded", "with_page", "exact_scope", every("_home").alias("homepage_only"), every("_list").alias("listing_only"), *map(zero, ("fresh", "soft_stale", "hard_stale", "active_refresh")), "in_sync", "pending", "failed", "incomplete"
    )


def announcement_facts(rows: DataFrame, sources: DataFrame, pages: DataFrame, now: int, key: str = "unit") -> DataFrame:
    """Per key the counters over announcements that the latest list of their source holds, each url once, and the share of
    the key's sources that were crawled within the soft window.

    rows: (key, canonical_url, source, scope_unit, last_crawled_s, warning), sources: (name, unit, last_success_s,
    canonical_urls, keys), keys being those whose coverage a source counts for. What a source no longer lists proves
    nothing of the latest state; only `in_sync` counts it too. Lists are taken apart and met by name and url.
    """
    c = F.col
    listed = sources.select(c("name").alias("source"), F.explode("canonical_urls").alias("canonical_url")).distinct().withColumn("_listed", F.lit(True))
    known = rows.join(sources.select(c("name").alias("source"), c("unit").alias("_unit")), "source").join(listed, ["source", "canonical_url"], "left")
    known = known.join(pages.select(*PAGE).drop("last_success_s").withColumn("_page", F.lit(True)), "canonical_url", "left")
    step = c("_page") & c("content_hash").isNotNull() & (c("content_hash") == c("ingestion_content_hash")) & c("ingestion_status").isin(*IN_STEP) & c("announcement_ingestion_status").isin(*LISTED)
    all_of = known.groupBy(key).agg(F.count_if(step).alias("in_sync"))
    first = Window.partitionBy(key, "canonical_url").orderBy("source", "last_crawled_s")
    one = known.where("_listed").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    a, b = c("ingestion_status"), c("announcement_ingestion_status")
    true = lambda x: F.coalesce(x, F.lit(False))
    pending = true(a == "pending") | true(b == "pending")
    failed = ~pending & (c("warning").isNotNull() & (c("warning") != "") | true(a.isin(*FAILED)) | true(b.isin(*FAILED)))
    now_of = one.groupBy(key).agg(
        F.count("*").alias("documents"), F.count_if(c("_unit") == c("scope_unit")).alias("exact_scope"), F.count_if(pending).alias("pending"), F.count_if(failed).alias("failed"), F.count_if(true(b == "incomplete")).alias("incomplete"), *_counters(now, F.lit(now) - c("last_crawled_s"), ANN_SOFT, ANN_HARD)
    )
    covered = sources.select(F.explode("keys").alias(key), (F.lit(now) - c("last_success_s")).alias("_age")).groupBy(key).agg(F.count("*").alias("sources"), F.count_if(c("_age") <= ANN_SOFT).alias("fresh_sources"))
    names = ["documents", "exact_scope", "fresh", "soft_stale", "hard_stale", "active_refresh", "in_sync", "pending", "failed", "incomplete", "sources", "fresh_sources"]
    joined = all_of.join(now_of, key, "left").join(covered, key, "left").select(key, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    return joined.withColumn("coverage", F.round(F.coalesce(F.try_divide(c("fresh_sources").cast("double"), c("sources").cast("double")), F.lit(0.0)), 9))


def evidence_quality(evidence: DataFrame, key: str, strong: float = STRONG_SCORE, chars: int = STRONG_CHARS) -> DataFrame:
    """Per key of evidence (score, content): pieces that are strong and long enough, the top score, and its lead.

    Scores below 0 count as 0; the lead is over the second score, over nothing if there is none. The two best scores
    combine before the shuffle.
    """
    score = F.greatest(F.lit(0.0), F.col("score"))
    enough = (F.col("score") >= strong) & (F.length(F.trim("content")) >= chars)
    places = evidence.select(key, score.alias("_s"), enough.alias("_strong")).groupBy(key, "_s").agg(F.count("*").alias("_n"), F.count_if("_strong").alias("_strong"))
    best = Window.partitionBy(key).orderBy(F.desc("_s"))
    two = places.withColumn("_at", F.row_number().over(best))
    second = F.coalesce(F.max(F.when((F.col("_at") == 1) & (F.col("_n") > 1), F.col("_s"))), F.max(F.when(F.col("_at") == 2, F.col("_s"))))
    counts = two.groupBy(key).agg(F.sum("_strong").alias("strong"), F.max("_s").alias("top_score"), second.alias("_second"))
    return counts.select(key, "strong", "top_score", F.round(F.col("top_score") - F.coalesce("_second", F.lit(0.0)), 9).alias("margin"))


def decision(facts: DataFrame, live_fallback: bool = True) -> DataFrame:
    """facts with action, reason and limit: the first rule that holds, and what then kept a live search from being made.

    Columns of facts: intent, ok, active_refresh, homepage_only, listing_only, documents, incomplete, exact_scope,
    hard_stale, pending, failed, in_sync, soft_stale, sources, coverage, fresh, evidence, strong, top_score, margin,
    seconds_left.
    """
    c = F.col
    topic, listing = c("intent").isin(*TOPICS), c("intent").isin(*LISTS)
    keyword = c("intent") == "keyword_announcement"
    usable = listing & (c("evidence") > 0) & (c("documents") > 0)
    weak_list = keyword & usable & (c("fresh") > 0)
    low = c("coverage") < LEAST_COVERAGE
    scoped = c("intent").isin("scoped_topic", "announcement") & (c("exact_scope") > 0) & (c("top_score") >= SCOPED_SCORE) & (c("fresh") > 0) & ((c("in_sync") > 0) | (c("intent") == "announcement") & (c("documents") > 0))
    lead = c("margin") >= LEAST_MARGIN
    use, refresh, warn, live = "use_db", "use_db_and_schedule_refresh", "use_db_with_incomplete_warning", "insufficient"
    rules: list[tuple[Column, str, str]] = [
        (~c("ok"), live, "facts_query_failed"),
        (c("active_refresh") > 0, warn, "active_refresh_in_progress"),
        ((c("homepage_only") > 0) & topic, live, "homepage_only_for_topic_query"),
        ((c("listing_only") > 0) & topic, live, "missing_listing_coverage"),
        ((c("documents") == 0) & topic, live, "site_map_only_without_document"),
        ((c("incomplete") > 0) & c("intent").isin("announcement", "keyword_announcement"), warn, "terminal_incomplete"),
        ((c("documents") == 0) & listing, live, "missing_listing_coverage"),
        ((c("intent") == "scoped_topic") & (c("exact_scope") == 0), live, "missing_unit_coverage"),
        ((c("hard_stale") > 0) & (c("intent") == "latest"), live, "recent_query_requires_freshness"),
        (c("hard_stale") > 0, refresh, "hard_stale"),
        ((c("pending") > 0) | topic & (c("in_sync") < 1), refresh, "relevant_ingestion_pending"),
        (c("failed") > 0, refresh, "relevant_ingestion_failed"),
        (c("soft_stale") > 0, refresh, "stale_but_usable"),
        (listing & (c("sources") > 1) & low, refresh, "insufficient_source_coverage"),
        (c("intent").isin("latest", "announcement") & usable & (c("fresh") > 0), use, "fresh_announcement_snapshot"),
        (listing & low, refresh, "insufficient_source_coverage"),
        ((c("strong") == 0) & weak_list, refresh, "weak_but_usable_announcement_evidence"),
        (c("strong") == 0, live, "weak_retrieval_score"),
        (scoped, use, "exact_scoped_match"),
        ((c("strong") >= LEAST_STRONG) & (c("fresh") > 0) & (lead | (c("strong") > 1)), use, "fresh_strong_evidence"),
        (~lead & weak_list, refresh, "ambiguous_but_usable_announcement_evidence"),
        (~lead, live, "insufficient_score_margin"),
        (weak_list, refresh, "sparse_but_usable_announcement_evidence"),
    ]
    chain = None
    for when, action, reason in rules:
        value = F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
        chain = F.when(when, value) if chain is None else chain.when(when, value)
    chosen = facts.withColumn("_d", chain.otherwise(F.struct(F.lit(live).alias("action"), F.lit("insufficient_result_count").alias("reason"))))
    # Too little for an answer: look it up live if there is time for that.
    limit = F.when(c("_d.action") != live, F.lit(None).cast("string")).when(F.lit(not live_fallback), "live_fallback_disabled").when(c("seconds_left") < LEAST_SECONDS, "deadline_insufficient")
    action = F.when(c("_d.action") != live, c("_d.action")).when(limit.isNotNull(), warn).otherwise("use_bounded_live_fallback")
    return chosen.withColumn("action", action).withColumn("limit", limit).withColumn("reason", c("_d.reason")).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("top_score")))).drop("_d")
