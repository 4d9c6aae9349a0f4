"""Crawl attempts as an append-only log: leases and page states are its fold, and a row counts only from who holds the lease."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.shipping import ship

#: A log row: who (owner, token) says what (event) of a page and when; `seq` orders rows of one second. `seconds` is the
#: length of a lease, `status` and `next_s` what a fetch leads to, `deactivate` ends a page.
LOG = ["page_id", "at_s", "seq", "event", "owner", "token", "seconds", "status", "next_s", "changed", "http_status", "deactivate"]
#: The state of a page.
STATE = ["lease_owner", "lease_token", "lease_expires_s", "crawl_status", "failure_count", "changed_streak", "unchanged_streak", "next_crawl_s", "last_success_s", "is_active"]
_LOG_TYPES = dict(zip(LOG, ["long", "long", "long", "string", "string", "string", "long", "string", "long", "boolean", "int", "boolean"], strict=True))
_STATE_TYPES = dict(zip(STATE, ["string", "string", "long", "string", "int", "int", "int", "long", "long", "boolean"], strict=True))
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
#: What a page is in before it has a state, and while it is being fetched.
NEW, FETCHING = "discovered", "fetching"
BLOCKED, EXCLUDED = "blocked", "excluded"


def step(state: list, row: dict) -> bool:
    """Apply one log row to a page's state, in place; whether it counts.

    A claim counts if no lease is live. What else says `renew`, `complete` or `fail` counts only with the owner and the
    token of the lease, before it expires; completing and failing end it.
    """
    owner, token, expires = state[:3]
    live = expires is not None and expires > row["at_s"]
    event = row["event"]
    if event == "claim":
        if live:
            return False
        state[:4] = row["owner"], row["token"], row["at_s"] + row["seconds"], FETCHING
        return True
    if not live or row["owner"] != owner or row["token"] != token:
        return False
    if event == "renew":
        state[2] = row["at_s"] + row["seconds"]
        return True
    state[:3] = None, None, None
    state[3] = row["status"]
    state[7] = row["next_s"]
    if event == "complete":
        state[4], state[8] = 0, row["at_s"]
        if row["changed"] is not None:
            state[5], state[6] = (state[5] + 1, 0) if row["changed"] else (0, state[6] + 1)
    else:
        state[4] += 1
        state[9] = state[9] and not row["deactivate"]
    return True


def replayed(log: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Each log row with `accepted` and the page's state after it.

    `pages` (page_id and the columns of `STATE`) is where the log takes over: the fold of an older log need not be made
    again. Rows are taken by page, time and seq, and stream through a sorted partition: a task holds one page's state,
    however long its log. Events of other names, and rows without a page, time or name, count for nothing.
    """
    names = [*LOG, "accepted", *STATE]
    kinds = [_ARROW[t] for t in (*_LOG_TYPES.values(), "boolean", *_STATE_TYPES.values())]
    new = [None, None, None, NEW, 0, 0, 0, None, None, True]

    def run(batches):
        page, state = object(), list(new)
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["page_id"] != page:
                    page, state = row["page_id"], list(new)
                if row["event"] is None:  # the state from before
                    state = [row[f"_{c}"] for c in STATE]
                    continue
                counts = row["event"] in ("claim", "renew", "complete", "fail") and row["at_s"] is not None and page is not None and step(state, row)
                out.append([*(row[c] for c in LOG), counts, *state])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    spark = log.sparkSession
    ship(spark)
    none = [F.lit(None).cast(t).alias(f"_{c}") for c, t in _STATE_TYPES.items()]
    rows = log.where("event is not null").select(*[F.col(c).cast(t).alias(c) for c, t in _LOG_TYPES.items()], *none)
    if pages is not None:
        before = [F.col("page_id").cast("long").alias("page_id"), *[F.lit(None).cast(t).alias(c) for c, t in _LOG_TYPES.items() if c != "page_id"]]
        rows = rows.union(pages.select(*before, *[F.col(c).cast(t).alias(f"_{c}") for c, t in _STATE_TYPES.items()]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "page_id").sortWithinPartitions("page_id", F.col("event").isNotNull(), "at_s", "seq")
    return ordered.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in (*_LOG_TYPES.items(), ("accepted", "boolean"), *_STATE_TYPES.items())))


def states(replay: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, state) after the log; pages that it does not name keep theirs."""
    last = replay.groupBy("page_id").agg(F.max_by(F.struct(*STATE), F.struct("at_s", "seq")).alias("s")).select("page_id", "s.*")
    if pages is None:
        return last
    kept = pages.select("page_id", *STATE).join(last.select("page_id"), "page_id", "left_anti")
    return last.unionByName(kept)


def outcome():
    """What an accepted last row of an attempt says came of it."""
    c = F.col
    good = F.when(c("changed"), "success_changed").when(c("http_status") == 304, "not_modified").otherwise("success_unchanged")
    bad = F.when(c("status") == BLOCKED, BLOCKED).when(F.coalesce("deactivate", F.lit(False)), EXCLUDED).otherwise("failed_transient")
    return F.when(c("event") == "complete", good).otherwise(bad)


def attempts(replay: DataFrame) -> DataFrame:
    """(page_id, token, owner, started_s, finished_s, outcome, seconds) of every claim that counted.

    An attempt is running until its own worker completes or fails it, or comes too late with anything: then the lease is
    lost, and what comes later changes no more.
    """
    c = F.col
    claim = (c("event") == "claim") & c("accepted")
    own = Window.partitionBy("page_id", "token").orderBy("at_s", "seq")
    began = F.last(F.when(claim, F.struct("owner", "at_s")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    ends = (c("event") != "claim") & c("event").isin("renew", "complete", "fail") & (c("owner") == c("_b.owner")) & ~((c("event") == "renew") & c("accepted"))
    told = replay.withColumn("_b", began).where(c("_b").isNotNull())
    end = F.min_by(F.struct("at_s", F.when(c("accepted"), outcome()).otherwise("lease_lost").alias("outcome")), F.when(ends, F.struct("at_s", "seq")))
    grouped = told.groupBy("page_id", "token").agg(F.min("_b").alias("b"), F.max(ends).alias("ended"), end.alias("e"))
    done = F.when(c("ended"), c("e.at_s"))
    return grouped.select("page_id", "token", c("b.owner").alias("owner"), c("b.at_s").alias("started_s"), done.alias("finished_s"), F.when(c("ended"), c("e.outcome")).otherwise("running").alias("outcome"), F.when(c("ended"), F.greatest(F.lit(0).cast("long"), done - c("b.at_s"))).alias("seconds"))


def reported(replay: DataFrame, since_s: int) -> DataFrame:
    """(outcome, attempts) of attempts that began at `since_s` or later."""
    return attempts(replay).where(F.col("started_s") >= since_s).groupBy("outcome").agg(F.count("*").alias("attempts"))
