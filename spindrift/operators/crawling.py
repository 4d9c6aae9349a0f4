"""Fair due selection, leases, transitions, status and streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import schedule, urls
from spindrift.operators.sitegraph import CLOSED, DEPTH, eligible


def live(now: int):
    return F.coalesce(F.col("lease_expires_s") > now, F.lit(False))


def due(pages: DataFrame, now: int, limit: int, depth: int = DEPTH, per_host: int = 1, active: int = 1) -> DataFrame:
    """Pages to fetch now, hosts taking turns: of each host the best first, as many as it has room for.

    Eligible, no resource, due at `now` (a page without a due time is not), without a live lease, within the depth. A
    host has room for `per_host` pages, and for no more than `active` together with its active pages under a live lease.
    """
    busy = pages.where(live(now) & F.col("is_active")).groupBy("host").agg(F.count("*").alias("_busy"))
    ready = eligible(pages).where((F.col("next_crawl_s") <= now) & ~live(now) & (F.col("minimum_depth") <= depth) & ~urls.is_resource(F.col("url")))
    order = [F.desc("crawl_priority"), F.asc_nulls_first("next_crawl_s"), F.asc("minimum_depth"), F.asc("failure_count"), F.asc("page_id")]
    turn = F.row_number().over(Window.partitionBy("host").orderBy(*order))
    room = F.least(F.lit(per_host), F.lit(active) - F.coalesce("_busy", F.lit(0)))
    chosen = ready.join(busy, "host", "left").withColumn("_room", room).where("_room > 0").withColumn("host_rank", turn).where(F.col("host_rank") <= F.col("_room"))
    return chosen.drop("_busy", "_room").orderBy("host_rank", *order).limit(limit)


def claimed(pages: DataFrame, chosen: DataFrame, owner: str, now: int, seconds: int) -> DataFrame:
    """Pages with the chosen ones leased; each lease's token follows from page, owner and time."""
    ids = chosen.select("page_id", F.lit(True).alias("_mine"))
    token = F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), F.lit(owner), F.lit(str(now))).cast("binary"), 256)
    mine = F.coalesce("_mine", F.lit(False))
    return (
        pages.join(ids, "page_id", "left")
        .withColumn("lease_owner", F.when(mine, F.lit(owner)).otherwise(F.col("lease_owner")))
        .withColumn("lease_token", F.when(mine, token))
        .withColumn("lease_expires_s", F.when(mine, F.lit(now + seconds)).otherwise(F.col("lease_expires_s")))
        .drop("_mine")
    )


def finished(pages: DataFrame, reports: DataFrame, now: int) -> DataFrame:
    """(page_id, outcome): reports count only from who holds a live lease by owner and token, others lost it.

    reports: (page_id, lease_owner, lease_token, outcome).
    """
    held = pages.select("page_id", F.col("lease_owner").alias("_owner"), F.col("lease_token").alias("_token"), live(now).alias("_live"))
    fenced = F.coalesce((F.col("_owner") == F.col("lease_owner")) & (F.col("_token") == F.col("lease_token")) & F.col("_live"), F.lit(False))
    return reports.join(held, "page_id", "left").select("page_id", F.when(fenced, F.col("outcome")).otherwise("lease_lost").alias("outcome"))


def scheduled(pages: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """Due times moved forward, never back, to those wanted (page_id, run_at_s); leased and closed pages keep theirs."""
    moved = ~live(now) & ~F.col("crawl_status").isin(*CLOSED) & F.col("run_at_s").isNotNull()
    at = F.when(moved, F.least("run_at_s", F.coalesce("next_crawl_s", "run_at_s"))).otherwise(F.col("next_crawl_s"))
    return pages.join(wanted, "page_id", "left").withColumn("next_crawl_s", at).drop("run_at_s")


#: Statuses of pages that wait to be fetched, and ingestion states that want work.
WAITING, UNDONE = ("discovered", "queued", "failed", "fetching"), ("pending", "failed")


def status(pages: DataFrame, now: int) -> DataFrame:
    """One row of counts over one scan.

    Pending pages are those eligible without a live lease, due ones of these those whose time has come; the next time is
    the earliest of any pending one, past or future.
    """
    c = F.col
    open_to = c("is_active") & c("is_indexable") & ~c("crawl_status").isin(*CLOSED) & ~live(now)
    hashed = c("content_hash").isNotNull()
    undone = F.coalesce(c("ingestion_status").isin(*UNDONE), F.lit(False)) | F.coalesce(c("announcement_ingestion_status").isin(*UNDONE), F.lit(False))
    return pages.agg(
        F.count_if(open_to & (c("next_crawl_s") <= now)).alias("due"),
        F.count_if(open_to).alias("pending"),
        F.count_if(live(now)).alias("leased"),
        F.count_if(c("crawl_status") == "failed").alias("failed"),
        F.count_if(c("crawl_status") == "blocked").alias("blocked"),
        F.count_if(hashed & undone).alias("ingestion_pending"),
        F.count_if(hashed & (c("announcement_ingestion_status") == "incomplete")).alias("ingestion_incomplete"),
        F.countDistinct(F.when(live(now), c("lease_owner"))).alias("workers"),
        F.min(F.when(open_to, c("next_crawl_s"))).alias("next_due_s"),
    )


def histogram(attempts: DataFrame, since, outcomes: list[str]) -> DataFrame:
    """Attempts of each outcome since a moment, with zeros for those without any."""
    spark = attempts.sparkSession
    known = spark.createDataFrame([(o,) for o in outcomes], "outcome string")
    counts = attempts.where(F.col("started_at") >= since).groupBy("outcome").agg(F.count("*").alias("n"))
    return known.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("attempts"))


def streaks(attempts: DataFrame) -> DataFrame:
    """Per page the length of its latest run of equal content_changed, by start, then id."""
    latest = Window.partitionBy("page_id").orderBy(F.desc("started_at"), F.desc("attempt_id"))
    upto = latest.rowsBetween(Window.unboundedPreceding, 0)
    rows = attempts.withColumn("now", F.first("content_changed").over(latest)).withColumn("broken", F.max((F.col("content_changed") != F.col("now")).cast("int")).over(upto))
    return rows.where("broken = 0").groupBy("page_id").agg(F.first("now").alias("changed"), F.count("*").alias("streak"))


def waiting(pages: DataFrame) -> DataFrame:
    """Eligible pages that wait to be fetched: these fill the frontier."""
    return eligible(pages).where(F.col("crawl_status").isin(*WAITING))


def host_pending(pages: DataFrame) -> DataFrame:
    """Waiting pages of each host and, with a null host, of all: one rollup."""
    return waiting(pages).rollup("host").agg(F.count("*").alias("pending"))


def _state(changed, outcome):
    c = F.col
    return schedule.state_identity(c("url"), c("page_type"), changed, c("changed_streak"), c("unchanged_streak"), c("failure_count"), c("crawl_priority"), outcome)


def after_success(pages: DataFrame) -> DataFrame:
    """(page_id, delay_s): jittered seconds until the next fetch, by whether the page changed."""
    changed = F.col("page_id") % 2 == 0
    plain = schedule.success_delay(F.col("page_type"), F.col("crawl_priority"), changed, F.col("changed_streak"), F.col("unchanged_streak"))
    return pages.select("page_id", F.round(schedule.jittered(plain, _state(changed, F.lit("success")), schedule.MOST), 6).alias("delay_s"))


def after_failure(pages: DataFrame) -> DataFrame:
    """(page_id, action, delay_s): what a failed fetch leads to; a server's wish is kept to without jitter."""
    action = schedule.failure_action(F.col("http_status"), F.col("failure_count"))
    plain = schedule.retry_delay(F.col("page_type"), F.col("crawl_priority"), F.col("failure_count"), F.col("changed_streak"), F.col("unchanged_streak"))
    own = schedule.jittered(plain, _state(F.lit(None).cast("boolean"), F.concat(F.lit("failure:"), F.coalesce(F.col("http_status").cast("string"), F.lit("unknown")))), schedule.RETRY_MOST)
    delay = F.coalesce(schedule.retry_after(F.col("http_status"), F.col("retry_after")), own)
    return pages.select("page_id", action.alias("action"), F.when(action == "failed", F.round(delay, 6)).alias("delay_s"))


def monotone_watermark(attempts: DataFrame) -> DataFrame:
    """The latest start of each page, whatever order attempts arrive in, and what came of it."""
    last = F.max_by(F.struct("outcome", "attempt_id"), F.struct("started_at", "attempt_id"))
    return attempts.groupBy("page_id").agg(F.max("started_at").alias("watermark"), last.alias("last")).select("page_id", "watermark", F.col("last.outcome").alias("outcome"))


#: Fixed: targets that one request may name, and why none or not all of them were scheduled.
TARGETS = 220
TOO_MANY, PAGES_SHORT, SOURCES_SHORT = "refresh_target_limit_exceeded", "page_schedule_incomplete", "source_schedule_incomplete"


def schedulable(pages: DataFrame, now: int) -> DataFrame:
    """Pages that may be made due: eligible, no resource, under no live lease of crawl or ingestion."""
    working = F.coalesce(F.col("ingestion_lease_expires_s") > now, F.lit(False))
    return eligible(pages).where(~live(now) & ~working & ~urls.is_resource(F.col("url")))


def accepted(requests: DataFrame, wanted: DataFrame, wanted_sources: DataFrame, pages: DataFrame, sources: DataFrame, now: int, most: int = TARGETS) -> DataFrame:
    """(request, requested, accepted, targets, scheduled, reason): whether each request is taken as a whole.

    requests: (request, reason), wanted: (request, canonical_url), wanted_sources: (request, name). A request without
    targets asks for nothing; one with too many, or with a page or a source that cannot be scheduled, is not accepted.
    sources: (name), those that may be made due.
    """
    count = lambda rows, key, name: rows.groupBy("request").agg(F.count("*").alias(name))
    one, named = wanted.select("request", "canonical_url").distinct(), wanted_sources.select("request", "name").distinct()
    fine = schedulable(pages, now).select("canonical_url").distinct()
    parts = [count(one, "canonical_url", "_urls"), count(one.join(fine, "canonical_url"), "canonical_url", "_pages"), count(named, "name", "_names"), count(named.join(sources.select("name").distinct(), "name"), "name", "_sources")]
    out = requests.select("request", "reason")
    for part in parts:
        out = out.join(part, "request", "left")
    c = {n: F.coalesce(n, F.lit(0)) for n in ("_urls", "_pages", "_names", "_sources")}
    total, done = c["_urls"] + c["_names"], c["_pages"] + c["_sources"]
    short = F.when(total > most, TOO_MANY).when(c["_pages"] < c["_urls"], PAGES_SHORT).when(c["_sources"] < c["_names"], SOURCES_SHORT)
    return out.select("request", (total > 0).alias("requested"), ((total == 0) | short.isNull()).alias("accepted"), total.alias("targets"), F.when(total > most, F.lit(0).cast("long")).otherwise(done).alias("scheduled"), F.when(total == 0, F.col("reason")).otherwise(F.coalesce(short, F.col("reason"))).alias("reason"))


#: Which counter of a report an outcome belongs to.
COUNTED = {"changed": ("changed",), "unchanged": ("unchanged", "lease_not_acquired"), "failed": ("failed", "blocked", "binary", "unsupported", "lease_lost", "ingestion_failed")}


def report(results: DataFrame) -> DataFrame:
    """One row of a run: sources attempted, succeeded and failed, and pages changed, unchanged and failed.

    results: (source, outcome, n) as a run counted them; a source succeeded if it has no page that failed. Other outcomes,
    such as skipped, count for no page.
    """
    own = results.groupBy("source").agg(*[F.coalesce(F.sum(F.when(F.col("outcome").isin(*names), F.col("n"))), F.lit(0)).alias(k) for k, names in COUNTED.items()])
    total = own.agg(F.count("*").alias("sources_attempted"), F.count_if(F.col("failed") == 0).alias("sources_succeeded"), F.count_if(F.col("failed") > 0).alias("sources_failed"), *[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in COUNTED])
    return total.withColumn("status", F.when(F.col("sources_failed") > 0, "failed").otherwise("completed"))
