"""Connected components by alternating large-star and small-star rounds, every round a few small shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import forget, spread_join, written


def connected_components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """One row (node, component) for each node that an edge names; component is the smallest node reachable.

    Each round points every node at the least node it knows of: a minimum per node (combined before the shuffle)
    joined back to the edges; the least nodes of hubs are broadcast, so that no task gets all edges of one. Rounds end
    when the edges no longer change; self-loops, repeated edges and an empty table are fine, edges with a null end are
    ignored.
    """
    now = written(
        edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where(f"`{u}` is not null and `{v}` is not null and a <> b").distinct(),
        "edges",
    )
    seen, edges_now = None, now.count()
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, least, ["a"], "n", edges_now).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, ["a"], "n", edges_now).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = written(small, "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = new
        if mark == seen:
            break
        seen, edges_now = mark, mark[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
