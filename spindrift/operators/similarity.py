"""Joins by trigram likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text


def similar_texts(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right, likeness) of the different texts of two one-column tables whose trigrams are alike enough.

    A text of n trigrams that is alike enough to another shares at least ceil(least n) of them, so one of its rarest
    n - ceil(least n) + 1: texts meet only on those, the rarest first over both tables, which leaves out what most texts
    have. Of those that they share in these prefixes and the rest of the text whose prefix ends first, which may all be
    shared, there must be enough; then pairs are compared whole. Texts without trigrams are like none.
    """

    def listed(df: DataFrame) -> DataFrame:
        return df.select(F.col(df.columns[0]).alias("text")).where("text is not null").distinct().select("text", text.trigrams(F.col("text")).alias("grams"))

    a, b = listed(left), listed(right)
    counts = a.union(b).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select("text", F.explode("grams").alias("gram")).join(counts, "gram")
        placed = each.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
        size = F.size("g")
        keep = size - F.ceil(F.lit(least) * size - F.lit(1e-9)).cast("int") + 1
        return placed.select(F.col("text").alias(name), size.alias(f"{name}_size"), (size - keep).alias(f"{name}_rest"), F.explode(F.slice("g", F.lit(1), keep)).alias("g")).select(name, f"{name}_size", f"{name}_rest", "g.gram")

    fits = F.least("left_size", "right_size") >= F.lit(least - 1e-9) * F.greatest("left_size", "right_size")
    shared = rarest(a, "left").join(rarest(b, "right"), "gram").where(fits).groupBy("left", "right", "left_size", "right_size", "left_rest", "right_rest").agg(F.count("*").alias("n"))
    enough = F.lit(least / (1 + least)) * (F.col("left_size") + F.col("right_size")) - F.lit(1e-9)
    met = shared.where(F.col("n") + F.greatest("left_rest", "right_rest") >= enough).select("left", "right")
    whole = met.join(a.select(F.col("text").alias("left"), F.col("grams").alias("ga")), "left").join(b.select(F.col("text").alias("right"), F.col("grams").alias("gb")), "right")
    return whole.select("left", "right", text.jaccard(F.col("ga"), F.col("gb")).alias("likeness")).where(F.col("likeness") >= least)
