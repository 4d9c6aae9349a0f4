"""Streams over append-only tables: keyed merges, expiring sessions, rate limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ALLOWED = "user_id long, event_id long, allowed boolean"
#: The session setting that keyed state with timers needs, and its value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def outcome_windows(attempts: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Attempts by hour and outcome; what comes later than `late` is left out."""
    return attempts.withWatermark("started_at", late).groupBy(F.window("started_at", width), "outcome").agg(F.count("*").alias("attempts")).select(F.col("window.start").alias("hour"), "outcome", "attempts")


def expiring_sessions(events: DataFrame, late: str = "1 day", gap: str = "24 hours") -> DataFrame:
    """Lives of users that end a gap after their latest event."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "events")


class Limiter(StatefulProcessor):
    """One user's events in the order of their times, whatever order they arrive in.

    An event waits, under its millisecond, until the watermark has passed it: a timer then judges what waits there. The
    moments of allowed events are kept while they count, at most `limit` of them, and another timer drops the last of
    them when the window has passed; a user who falls silent leaves no state.
    """

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at_ms long", "events array<long>")
        self.kept = handle.getListState("kept", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for at, event in zip(part["at"].tolist(), part["event_id"].tolist(), strict=True):
                at_ms = -(-at // 1000)
                if at_ms <= passed:
                    continue  # too late to be judged in order
                held = list(self.waiting.getValue((at_ms,))[0]) if self.waiting.containsKey((at_ms,)) else []
                if not held:
                    self.handle.registerTimer(at_ms)
                self.waiting.updateValue((at_ms,), ([*held, at, event],))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = expiredTimerInfo.getExpiryTimeInMs()
        kept = deque(sorted(k[0] for k in self.kept.get()) if self.kept.exists() else [])
        out = []
        if self.waiting.containsKey((now_ms,)):
            held = [int(x) for x in self.waiting.getValue((now_ms,))[0]]
            for at, event in sorted(zip(held[::2], held[1::2], strict=True)):
                while kept and kept[0] <= at - self.window_us:
                    kept.popleft()
                out.append((event, len(kept) < self.limit))
                if out[-1][1]:
                    kept.append(at)
                    self.handle.registerTimer(-(-(at + self.window_us) // 1000))
            self.waiting.removeKey((now_ms,))
        while kept and kept[0] + self.window_us <= now_ms * 1000:
            kept.popleft()
        if kept:
            self.kept.put([(k,) for k in kept])
        else:
            self.kept.clear()
        if out:
            yield pd.DataFrame({"user_id": key[0], "event_id": [e for e, _ in out], "allowed": [a for _, a in out]})

    def close(self) -> None:
        pass


def rate_limits(events: DataFrame, limit: int, window_s: int, late: str = "1 hour") -> DataFrame:
    """As the batch limiter, once the watermark has passed an event; events that come later than `late` are left out.

    Needs the state store of RocksDB (`STORE`). events: (user_id, event_id, ts).
    """
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Limiter(limit, window_s * 1_000_000), ALLOWED, "Append", "EventTime")


class Turns(StatefulProcessor):
    """Numbers a conversation's messages as they come, and forgets a conversation that is silent for its lifetime."""

    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "next long, expires_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, expires = self.life.get() if self.life.exists() else (0, 0)
        for part in rows:
            part = part.sort_values(["at", "event_id"])
            numbers = list(range(number, number + len(part)))
            number += len(part)
            expires = max(expires, int(part["at"].max()) // 1000 + self.lifetime_ms)
            yield pd.DataFrame({"conv_id": key[0], "event_id": part["event_id"].tolist(), "turn": numbers})
        self.handle.registerTimer(expires)
        self.life.update((number, expires))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.life.exists() and self.life.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.life.clear()
        return iter(())

    def close(self) -> None:
        pass


def numbered(events: DataFrame, lifetime_s: int, late: str = "1 hour") -> DataFrame:
    """(conv_id, event_id, turn): running numbers of a conversation's messages, from 0 again after a silence of `lifetime_s`.

    Messages of one batch of a conversation go by time, those of later batches behind them. events: (conv_id, event_id, ts).
    """
    rows = events.select("conv_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withWatermark("ts", late)
    return rows.groupBy("conv_id").transformWithStateInPandas(Turns(lifetime_s * 1000), "conv_id long, event_id long, turn long", "Append", "EventTime")


def into_snapshots(stream: DataFrame, folder: str, key: str, order: str, checkpoint: str):
    """Keep the latest row of each key: every batch writes the next snapshot below `folder`, older arrivals change nothing.

    A batch that is repeated after a failure reads the same predecessor and writes the same snapshot again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch
        if number:
            latest = spark.read.schema(batch.schema).parquet(f"{folder}/{number - 1}").unionByName(batch)
        best = F.max_by(F.struct(*batch.columns), F.struct(F.col(order), F.xxhash64(*batch.columns))).alias("r")  # a tie goes the same way each time
        latest.groupBy(key).agg(best).select("r.*").write.mode("overwrite").parquet(f"{folder}/{number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
