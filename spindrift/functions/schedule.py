"""When a page is fetched again, as column expressions over epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: intervals in seconds, factors and limits of the schedule.
SUCCESS, UNCHANGED = 3600.0, 7200.0
LEAST, MOST = 60.0, 7 * 24 * 3600.0
RETRY, RETRY_FACTOR, RETRY_MOST = 60.0, 2.0, 24 * 3600.0
JITTER = 0.10
CHANGED_STEP, UNCHANGED_STEP, STREAK_MOST = 0.10, 0.25, 10
GONE_AFTER = 3
TYPE_FACTORS = {
    "unit_homepage": 0.75,
    "announcement_listing": 0.75,
    "announcement_detail": 0.85,
    "official_document": 1.0,
    "general_page": 1.0,
    "search_result": 1.25,
    "unknown": 1.0,
}


def _lookup(c: Column, table: dict, default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def factor(page_type: Column, priority: Column, changed: Column, changed_streak: Column, unchanged_streak: Column) -> Column:
    """Type, priority and streak together; without an outcome the longer streak decides, changes on a tie."""
    up = F.least(changed_streak, F.lit(STREAK_MOST))
    flat = F.least(unchanged_streak, F.lit(STREAK_MOST))
    often, seldom = F.lit(1.0) / (F.lit(1.0) + F.lit(CHANGED_STEP) * up), F.lit(1.0) + F.lit(UNCHANGED_STEP) * flat
    streak = F.when(changed.isNull(), F.when(up >= flat, often).otherwise(seldom)).when(changed, often).otherwise(seldom)
    return _lookup(page_type, TYPE_FACTORS, 1.0) * F.greatest(F.lit(0.25), F.lit(1.0) - F.greatest(priority, F.lit(0)) / F.lit(200.0)) * streak


def bounded(delay: Column, most: float) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(LEAST), delay))


def jittered(delay: Column, identity: Column, most: float) -> Column:
    """Up to a tenth more or less by the first 64 bits of the identity's SHA-256; no identity, no change."""
    unit = F.conv(F.substring(F.sha2(identity.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))
    moved = delay * (F.lit(1.0) + (unit * 2.0 - 1.0) * JITTER)
    return bounded(F.when(F.coalesce(identity, F.lit("")) == "", delay).otherwise(moved), most)


def state_identity(identity: Column, page_type: Column, changed: Column, changed_streak: Column, unchanged_streak: Column, failures: Column, priority: Column, outcome: Column) -> Column:
    """The key of a page's jitter: all that its schedule depends on; empty without an identity."""
    told = F.when(changed.isNull(), "None").when(changed, "True").otherwise("False")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    named = lambda name, c: F.concat(F.lit(f"|{name}="), c)
    key = F.concat(
        identity, named("page_type", text(page_type)), named("changed", told), named("changed_streak", text(changed_streak)), named("unchanged_streak", text(unchanged_streak)), named("failure_count", text(failures)), named("priority", text(priority)), named("outcome", outcome)
    )
    return F.when(F.coalesce(identity, F.lit("")) == "", F.lit("")).otherwise(key)


def success_delay(page_type: Column, priority: Column, changed: Column, changed_streak: Column, unchanged_streak: Column) -> Column:
    base = F.when(changed, SUCCESS).otherwise(UNCHANGED)
    return bounded(base * factor(page_type, priority, changed, changed_streak, unchanged_streak), MOST)


def retry_delay(page_type: Column, priority: Column, failures: Column, changed_streak: Column, unchanged_streak: Column) -> Column:
    base = F.lit(RETRY) * F.pow(F.lit(RETRY_FACTOR), F.greatest(failures - 1, F.lit(0)))
    return bounded(base * factor(page_type, priority, F.lit(None).cast("boolean"), changed_streak, unchanged_streak), RETRY_MOST)


def failure_action(status: Column, failures: Column) -> Column:
    """retry, blocked or excluded by HTTP status (null: no answer)."""
    return (
        F.when(status.isin(404, 410) & (failures >= GONE_AFTER), "excluded")
        .when(status.isin(401, 403), "blocked")
        .when(status.between(400, 499) & ~status.isin(404, 410, 429), "excluded")
        .otherwise("failed")
    )


def retry_after(status: Column, header: Column, now: int | None = None) -> Column:
    """Seconds a server asks for with 429 or 503, as a number or, if `now` is given, a date; null for anything else."""
    seconds = F.when(F.rlike(header, F.lit("^[0-9]{1,6}$")), F.try_to_number(F.when(F.rlike(header, F.lit("^[0-9]{1,6}$")), header), F.lit("999999")).cast("double"))
    if now is not None:
        date = F.try_to_timestamp(F.regexp_extract(header, "^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
        ahead = (F.unix_seconds(date) - F.lit(now)).cast("double")
        seconds = F.coalesce(seconds, F.when(ahead >= 0, ahead))
    return F.when(status.isin(429, 503) & seconds.isNotNull(), F.least(F.lit(RETRY_MOST), F.greatest(F.lit(LEAST), seconds)))


def duration_ms(began: Column, ended: Column) -> Column:
    """Milliseconds between two timestamps, never below 0."""
    return F.greatest(F.lit(0).cast("long"), F.timestamp_diff("MILLISECOND", began, ended))


def freshness(age_s: Column, soft_s: int, hard_s: int) -> Column:
    """fresh, soft_stale or hard_stale; unknown age is hard, limits themselves are within."""
    return F.when(age_s.isNull() | (age_s > hard_s), "hard_stale").when(age_s > soft_s, "soft_stale").otherwise("fresh")
