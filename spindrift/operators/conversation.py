"""Conversation logs: bounded context, sequence numbers, expiry; a sliding-window rate limiter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text

#: Fixed: messages and characters of a context, tool events and their characters, and what stands before these.
MESSAGES, CHARS, TOOLS, TOOL_CHARS = 12, 16_000, 2, 8_000
SUMMARY = "最近工具結果摘要："
LIFETIME_S = 24 * 3600


def context(events: DataFrame, messages: int = MESSAGES, chars: int = CHARS, tools: int = TOOLS, tool_chars: int = TOOL_CHARS) -> DataFrame:
    """(conv_id, turn, role, content): what of each conversation is shown to whom answers next.

    events: (conv_id, turn, role, text), role one of user, assistant and tool, whose text is JSON; others are left out. The
    latest `tools` tool events come first, as one row of role developer (turn null) with at most `tool_chars` characters.
    Then the latest messages that are not empty, as many as fit what is left of `chars`, the oldest of them cut to that.
    Personal data of messages are redacted first.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    told = events.where("role = 'tool'").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= tools).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("{}")).alias("text")))).alias("t"))
    summary = F.substring(F.concat(F.lit(SUMMARY), F.lit("["), F.array_join(F.transform("t", lambda x: x["text"]), ", "), F.lit("]")), 1, tool_chars)
    told = told.select("conv_id", summary.alias("content"))
    rows = events.where("role in ('user', 'assistant')").withColumn("content", text.redacted(F.coalesce("text", F.lit("")))).where("content <> ''")
    rows = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= messages)
    before = F.coalesce(F.sum(F.length("content")).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).join(told.select("conv_id", F.length("content").alias("_used")), "conv_id", "left")
    left = rows.withColumn("_left", (F.lit(chars) - F.coalesce("_used", F.lit(0)) - F.col("_before")).cast("int")).where("_left > 0")
    shown = left.select("conv_id", "turn", "role", F.substr("content", F.lit(1), F.col("_left")).alias("content"))
    return shown.unionByName(told.select("conv_id", F.lit(None).cast(events.schema["turn"].dataType).alias("turn"), F.lit("developer").alias("role"), "content"))


def next_sequence(events: DataFrame) -> DataFrame:
    return events.groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"))


def appended(events: DataFrame, turns: DataFrame) -> DataFrame:
    """events with new turns (conv_id, position, role, text) numbered after the latest of their conversation."""
    order = Window.partitionBy("conv_id").orderBy("position")
    known = next_sequence(events)
    new = turns.join(known, "conv_id", "left").withColumn("turn", (F.coalesce("next_turn", F.lit(0)) + F.row_number().over(order) - 1).cast("long"))
    return events.unionByName(new.select(events.columns))


def sessions(events: DataFrame, gap_s: int = LIFETIME_S) -> DataFrame:
    """Lives of a key (user_id, ts) that end `gap_s` after their latest event."""
    own = Window.partitionBy("user_id").orderBy("ts")
    step = events.withColumn("_new", F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(own)) >= F.lit(gap_s * 1_000_000), F.lit(True)).cast("int"))
    marked = step.withColumn("session", F.sum("_new").over(own.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("begins"), F.max("ts").alias("ends"), F.count("*").alias("events"))


def expired(rows: DataFrame, now: int, column: str = "expires_s") -> DataFrame:
    return rows.where(F.col(column) <= now)


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def rate_limited(events: DataFrame, limit: int, window_s: int) -> DataFrame:
    """(user_id, event_id, allowed): allowed if fewer than `limit` allowed ones lie within the last `window_s`.

    Whether an event counts depends on the ones before it, so users are worked through in order, each with at most
    `limit` moments in memory: rows arrive sorted and are streamed, not gathered by user.
    """

    def run(batches):
        from collections import deque

        user, kept = None, deque()
        for b in batches:
            allowed = []
            for u, at in zip(b["user_id"], b["at"], strict=True):
                if u != user:
                    user, kept = u, deque()
                while kept and kept[0] <= at - window_s * 1_000_000:
                    kept.popleft()
                allowed.append(len(kept) < limit)
                if allowed[-1]:
                    kept.append(at)
            yield pd.DataFrame({"user_id": b["user_id"], "event_id": b["event_id"], "allowed": allowed})

    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, "user_id long, event_id long, allowed boolean")
