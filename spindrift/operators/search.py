"""Bounded best-first search over the site graph, what it found, and whether to warn."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.sinks import shared

LEAST_SCORE, LEAST_LEXICAL, STRONG_DOCUMENT, FAILURES = 0.18, 0.25, 0.45, 5
HIGH, MARGIN, RESULTS = 0.75, 0.15, 2
#: Share of a page's worth that its links inherit.
RELAY = 0.3


def best_first(pages: DataFrame, links: DataFrame, seeds: DataFrame, turns: int = 20, per_host: int = 5, depth: int = 3, candidates: int = 200, relay: float = RELAY) -> DataFrame:
    """(search, turn, page_id, score, depth): what each of many searches visits, one page a turn, the best open one first.

    pages: (page_id, host, own), own being what a page is worth once it is read; links: (source_page_id, target_page_id,
    position, score); seeds: (search, page_id, score). A target is worth its link's score and `relay` of what its page is
    worth, 1 at most. A page that is found again with a better score moves up, and its older entry is void; one that was
    visited stays. A host gives `per_host` pages to a search, links lead `depth` steps from the seeds, and a search opens
    `candidates` pages at most, in the order of links. Equal scores go by the smaller page.

    This is a delta iteration: all searches take their turn in one round of joins, a priority queue being the open pages
    of a search. State is written each round, so lineage stays short; pages and links are read once a round.
    """
    spark = pages.sparkSession
    c = F.col

    def kept(df: DataFrame) -> DataFrame:
        path = f"{shared(spark)}/search-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    opened = kept(seeds.groupBy("search", "page_id").agg(F.max("score").cast("double").alias("score")).withColumn("depth", F.lit(0)))
    found = opened.select("search", "page_id")
    visited = None
    for turn in range(turns):
        here = opened.join(pages.select("page_id", "host", "own"), "page_id")
        if visited is not None:
            full = visited.groupBy("search", "host").agg(F.count("*").alias("_n")).where(c("_n") >= per_host)
            here = here.join(full, ["search", "host"], "left_anti")
        best = Window.partitionBy("search").orderBy(F.desc("score"), "page_id")
        picked = here.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("search", F.lit(turn).alias("turn"), "page_id", "score", "depth", "host", "own")
        picked = kept(picked)
        if picked.isEmpty():
            break
        visited = picked if visited is None else visited.unionByName(picked)
        seen = visited.select("search", "page_id")
        worth = F.least(F.lit(1.0), F.max("l.score") + relay * c("own"))
        out = picked.where(c("depth") < depth).alias("p").join(links.alias("l"), c("p.page_id") == c("l.source_page_id")).groupBy("search", c("l.target_page_id").alias("page_id"), "own", "depth").agg(worth.alias("score"), F.min("l.position").alias("position"))
        out = out.join(seen, ["search", "page_id"], "left_anti").join(found.withColumn("_known", F.lit(True)), ["search", "page_id"], "left")
        room = found.groupBy("search").agg((F.lit(candidates) - F.count("*")).alias("_room"))
        place = F.row_number().over(Window.partitionBy("search", c("_known").isNull()).orderBy("position", "page_id"))
        out = kept(out.join(room, "search").withColumn("_p", place).where(c("_known") | (c("_p") <= c("_room"))).select("search", "page_id", "score", (c("depth") + 1).alias("depth"), c("_known").isNull().alias("_new")))
        found = kept(found.unionByName(out.where("_new").select("search", "page_id")))
        older = opened.join(seen, ["search", "page_id"], "left_anti").withColumn("_age", F.lit(1))
        both = older.unionByName(out.drop("_new").withColumn("_age", F.lit(0)))
        opened = kept(both.groupBy("search", "page_id").agg(F.max("score").alias("score"), F.max_by("depth", F.struct("score", "_age")).alias("depth")))
    none = seeds.limit(0).select("search", F.lit(0).alias("turn"), "page_id", c("score").cast("double").alias("score"), F.lit(0).alias("depth"))
    return none if visited is None else visited.select("search", "turn", "page_id", "score", "depth")


def relevant(score: Column, scoped: Column, page_type: Column, items: Column) -> Column:
    """A page that scores, or a list with items of the unit that is asked about."""
    return (score >= LEAST_SCORE) | scoped & (page_type == "announcement_listing") & (items > 0)


def strong(lexical: Column, failures: Column, in_scope: Column, page_type: Column, wants: set[str], scoped: bool, root: Column | None = None) -> Column:
    """Whether a candidate could answer: likely, not failing, in scope, and of a type that is asked for.

    A question with a scope takes homepages and lists as well; without one a homepage must be the site's own (`root`)
    and asked for.
    """
    home = F.lit(True) if scoped else (F.lit(False) if root is None else root) & F.lit("homepage" in wants)
    fit = F.when(page_type == "unit_homepage", home).when(page_type == "announcement_listing", F.lit("announcement" in wants or scoped)).when(page_type == "official_document", F.lit("document" in wants) | (lexical >= STRONG_DOCUMENT)).otherwise(F.lit(True))
    return (lexical >= LEAST_LEXICAL) & (failures < FAILURES) & in_scope & fit


def diagnostics(visits: DataFrame) -> DataFrame:
    """One row of what a search met. visits: (state, score), state one of success, failure, unattempted."""
    of = lambda s: (F.col("state") == s) & (F.col("score") >= LEAST_SCORE)
    return visits.agg(
        F.count_if(of("success")).alias("successes"),
        F.count_if(of("failure")).alias("failures"),
        F.count_if((F.col("state") == "failure") & ~(F.col("score") >= LEAST_SCORE)).alias("other_failures"),
        *[F.max(F.when(F.col("state") == s, F.col("score"))).alias(f"best_{s}") for s in ("success", "failure", "unattempted")],
    )


def warning(successes: Column, failures: Column, best_success: Column, best_failure: Column, best_unattempted: Column, timed_out: Column) -> Column:
    """failed, partial or null."""
    best = F.coalesce(best_success, F.lit(0.0))
    return (
        F.when(successes == 0, F.when((failures > 0) | timed_out, "failed"))
        .when((successes >= RESULTS) & (best >= HIGH), F.lit(None).cast("string"))
        .when(best_failure > best + MARGIN, "partial")
        .when(timed_out & (best_unattempted > best + MARGIN), "partial")
    )


def dated_first(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("published_at"), "id").limit(limit)
