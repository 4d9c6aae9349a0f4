"""Ranked retrieval: keyword and vector lists, fused by reciprocal ranks, best chunk of each document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text, urls, vectors

#: Fixed: list length, rank offset, score weights and thresholds of retrieval.
LIST, RANK_OFFSET = 60, 60
WEIGHTS = {"raw": 0.72, "rank": 0.20, "concepts": 0.06, "title": 0.02}
SHORT_QUERY, LEAST_SIMILARITY = 4, 0.08
RELIABLE_SCORE, RELIABLE_CHARS, RELIABLE_RESULTS = 0.58, 160, 2


@dataclass(frozen=True)
class Scope:
    """What a query is about: a homepage, a unit, hosts; `general` is a unit whose rows are never out of scope."""

    homepage: str | None = None
    unit: str | None = None
    hosts: tuple[str, ...] = ()
    general: str | None = None


def boost(scope: Scope | None) -> Column:
    """What a row in scope is moved up by; not part of its score."""
    if scope is None:
        return F.lit(0.0)
    return (
        F.when(F.col("canonical_url") == F.lit(scope.homepage), 0.40)
        .when(F.col("unit") == F.lit(scope.unit), 0.24)
        .when(urls.below_root(F.col("canonical_url"), [f"https://{h}" for h in scope.hosts]), 0.18)
        .otherwise(0.0)
    )


def _top(scored: DataFrame, scope: Scope | None, limit: int) -> DataFrame:
    """The best `limit` rows of each list with their rank; a total order, and small heaps before the shuffle."""
    best = Window.partitionBy("list").orderBy(F.desc("_order"), "chunk_id")
    placed = scored.withColumn("_order", F.round(F.col("score") + boost(scope), 12)).withColumn("rank", F.row_number().over(best))
    return placed.where(F.col("rank") <= limit).select("list", "chunk_id", "document_id", "score", "rank")


def best_of(scored: DataFrame, scope: Scope | None = None, limit: int = LIST) -> DataFrame:
    """Ranked lists of scored rows (list, score, chunk_id, document_id, canonical_url, unit)."""
    return _top(scored, scope, limit)


def held(lists: DataFrame, n: int, limit: int = LIST) -> DataFrame:
    """`n` ranked lists of at most `limit` rows, read by the driver once, so that what follows does not make them again."""
    rows = lists.collect()
    if len(rows) > n * limit:
        raise ValueError(f"{n} lists hold more than {limit} rows each")
    return lists.sparkSession.createDataFrame(rows, lists.schema)


def keyword_lists(chunks: DataFrame, queries: list[str], scope: Scope | None = None, limit: int = LIST) -> DataFrame:
    """(list, chunk_id, document_id, score, rank): current chunks by the better trigram likeness of content and title.

    The trigrams of a chunk are listed once for all queries; a short query keeps all chunks.
    """
    grams = F.struct(text.trigrams(F.col("content")).alias("c"), text.trigrams(F.col("title")).alias("t"))
    likes = F.transform(F.array(grams), lambda g: F.array(*[F.greatest(*[text.likeness_to(g[c], q) for c in "ct"]) for q in queries]))[0]
    rows = chunks.where("is_current").select("chunk_id", "document_id", "canonical_url", "unit", F.posexplode(likes).alias("list", "score"))
    short = [i for i, q in enumerate(queries) if len(q) < SHORT_QUERY]
    return _top(rows.where((F.col("score") >= LEAST_SIMILARITY) | F.col("list").isin(*short, -1)), scope, limit)


def vector_lists(chunks: DataFrame, asked: dict[int, Column], scope: Scope | None = None, limit: int = LIST) -> DataFrame:
    """The same by cosine of the chunks' column embedding with each vector that asks, by the number of its list."""
    scores = F.array(*[F.struct(F.lit(i).alias("list"), F.round(F.coalesce(vectors.cosine(F.col("embedding"), v), F.lit(0.0)), 12).alias("score")) for i, v in asked.items()])
    return _top(chunks.where("is_current").select("chunk_id", "document_id", "canonical_url", "unit", F.explode(scores).alias("s")).select("*", "s.*").drop("s"), scope, limit)


def vector_table(chunks: DataFrame, asked: DataFrame, limit: int = LIST) -> DataFrame:
    """As `vector_lists` for a table of queries (list, vector), which is small enough to be sent to all tasks."""
    score = F.round(F.coalesce(vectors.cosine(F.col("embedding"), F.col("vector")), F.lit(0.0)), 12)
    return _top(chunks.where("is_current").join(F.broadcast(asked)).withColumn("score", score), None, limit)


def fuse(lists: DataFrame, n: int, chunks: DataFrame, queries: list[str], concepts: list[str], scope: Scope | None = None) -> DataFrame:
    """One row a chunk with its fused score: best raw score, reciprocal ranks, concepts and title taken together.

    `lists` are n ranked lists of at most `LIST` chunks each, so what they name is broadcast, and texts come last.
    """
    raw = F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))).alias("raw")
    ranks = F.sum(F.lit(1.0) / (F.lit(RANK_OFFSET) + F.col("rank"))).alias("ranks")
    named = lists.groupBy("chunk_id", "document_id").agg(raw, ranks)
    one = chunks.join(F.broadcast(named), ["chunk_id", "document_id"])
    by_rank = F.least(F.lit(1.0), F.col("ranks") * (RANK_OFFSET + 1) / max(1, n))
    found = text.coverage(F.concat_ws(" ", "title", "content", F.coalesce("unit", F.lit(""))), concepts)
    score = F.col("raw") * WEIGHTS["raw"] + by_rank * WEIGHTS["rank"] + found * WEIGHTS["concepts"] + text.contains_either(F.col("title"), queries).cast("double") * WEIGHTS["title"]
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    if scope is not None:
        home = F.rtrim(F.col("canonical_url"), F.lit("/")) == F.lit((scope.homepage or "").rstrip("/"))
        score = (
            F.when(home & F.lit(bool(scope.homepage)), F.greatest(score, F.lit(0.99)))
            .when(F.col("unit") == F.lit(scope.unit), F.least(F.lit(1.0), score + 0.18))
            .when(urls.host(F.col("canonical_url")).isin(*scope.hosts, ""), F.least(F.lit(1.0), score + 0.14))
            .when(F.col("unit") == F.lit(scope.general), score)
            .otherwise(score * 0.72)
        )
    return one.withColumn("score", score).drop("raw", "ranks")


def best_per_document(scored: DataFrame, limit: int) -> DataFrame:
    """The best chunk of each document, the best documents first."""
    own = Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    best = scored.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    return best.orderBy(F.desc("score"), "chunk_id").limit(limit)


def reliable(evidence: DataFrame, score: float = RELIABLE_SCORE, chars: int = RELIABLE_CHARS) -> DataFrame:
    """Evidence that is good and long enough to answer with."""
    return evidence.where((F.col("score") >= score) & (F.length(F.trim("content")) >= chars))


def enough(evidence: DataFrame, results: int = RELIABLE_RESULTS, **limits) -> DataFrame:
    """One row: how many are reliable, and whether that ends the search."""
    return reliable(evidence, **limits).agg(F.count("*").alias("reliable")).withColumn("stop", F.col("reliable") >= results)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.55, "medium").otherwise("low")
