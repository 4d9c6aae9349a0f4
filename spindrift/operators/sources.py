"""Feeds and their state: merges that keep a watermark from going back, forced runs, a diff against configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(sources: DataFrame, configured: DataFrame) -> DataFrame:
    """Sources after configuration (name, base_url, interval_minutes): known ones are overwritten, new ones were never crawled."""
    s, c = sources.alias("s"), configured.alias("c")
    pick = lambda n: F.coalesce(F.col(f"c.{n}"), F.col(f"s.{n}")).alias(n)
    return s.join(c, F.col("s.name") == F.col("c.name"), "full_outer").select(pick("name"), pick("base_url"), pick("interval_minutes"), F.col("s.last_success_s"))


def refreshed(sources: DataFrame, crawls: DataFrame, advance: bool = True) -> DataFrame:
    """Sources after crawls (name, crawled_s) in any order: the watermark is the latest, or stays where it may not advance."""
    latest = crawls.groupBy("name").agg(F.max("crawled_s").alias("_at"))
    at = F.greatest("last_success_s", "_at") if advance else F.col("last_success_s")
    return sources.join(latest, "name", "left").withColumn("last_success_s", at).drop("_at")


def forced(sources: DataFrame, names: list[str]) -> DataFrame:
    """The named sources as if never crawled, so that they are due."""
    return sources.withColumn("last_success_s", F.when(~F.col("name").isin(*names, ""), F.col("last_success_s")))


def unconfigured(sources: DataFrame, configured: DataFrame) -> DataFrame:
    """Names of sources without configuration."""
    return sources.join(configured.select("name"), "name", "left_anti").select("name")
