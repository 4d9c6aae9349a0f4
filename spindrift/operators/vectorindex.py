"""Nearest neighbours from vectors that are written by cell: a question reads the cells of its nearest centroids only.

Centroids are learned on a bounded sample, and on it the number of cells is found that a question must read for a given
recall; every vector is in the index. Reading all cells gives the exact result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spindrift.shipping import ship

#: Vectors that centroids are learned from, about; rounds of learning; vectors a cell on average.
SAMPLE, ROUNDS, PER_CELL = 20_000, 8, 64
#: The recall of the nearest `NEAR` that the sample must show, asked by so many of its vectors.
RECALL, NEAR, ASKED = 0.95, 10, 500
#: More cells than this are not made.
MOST_CELLS = 4_096
#: Questions that a task holds at once, and products that it makes at once.
QUESTIONS, PRODUCTS = 16_384, 1 << 21


@dataclass(frozen=True)
class Cells:
    """Unit centroids (cells, components), the cells that a question reads, and each cell's share of the sample, if known."""

    centroids: np.ndarray
    probes: int = 1
    shares: np.ndarray | None = None

    def nearest(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row by cosine, the smaller number first on ties."""
        close = np.round(rows @ self.centroids.T, 12)
        return close.argmax(axis=1)[:, None] if n == 1 else np.argsort(-close, axis=1, kind="stable")[:, :n]

    def asks(self, rows: np.ndarray, n: int) -> np.ndarray:
        """(cells, rows): whether a cell is among the n nearest of a row, as in `nearest`."""
        out = np.empty((len(self.centroids), len(rows)), bool)
        for s in range(0, len(rows), 512):
            close = np.round(rows[s : s + 512] @ self.centroids.T, 12)
            least = np.partition(close, -n, axis=1)[:, -n, None]
            above, ties = close > least, close == least
            out[:, s : s + 512] = (above | ties & (np.cumsum(ties, axis=1) <= n - above.sum(axis=1, keepdims=True))).T
        return out


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has a direction: no null or non-finite component, not zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0))


def _unit(rows) -> np.ndarray:
    x = np.array(list(rows), float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learned(rows: DataFrame, ident: str, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL, seed: int = 5) -> Cells:
    """Centroids of about `sample` vectors, chosen by a hash of their id; k-means on unit vectors. One length of vectors."""
    good = usable(rows)
    total = good.count()
    if not total:
        return Cells(np.zeros((0, 0)))
    share = min(1.0, sample / total)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(ident)), F.lit(1 << 20)) / float(1 << 20)
    chosen = good.where(place < share).select(ident, "embedding").orderBy(F.xxhash64(F.lit(seed), F.col(ident)), ident).limit(2 * sample).collect()
    x = _unit(r.embedding for r in chosen or good.limit(1).select("embedding").collect())
    k = max(1, min(cells or total // PER_CELL, MOST_CELLS, len(x)))
    c = x[:k].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([np.argmax(x[s : s + 1024] @ c.T, axis=1) for s in range(0, len(x), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    own = np.concatenate([np.argmax(x[s : s + 1024] @ c.T, axis=1) for s in range(0, len(x), 1024)])
    return Cells(c, _probes(x, c, recall), np.bincount(own, minlength=len(c)) / len(x))


def _probes(x: np.ndarray, c: np.ndarray, recall: float) -> int:
    """The fewest cells whose reading finds such a share of the nearest vectors in the sample. These lie farther off than
    those of the whole table, so it errs on the side of more."""
    own = np.concatenate([np.argmax(x[s : s + 1024] @ c.T, axis=1) for s in range(0, len(x), 1024)])
    places = []
    for s in range(0, min(ASKED, len(x)), 100):
        asked = x[s : min(s + 100, ASKED)]
        near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : NEAR + 1]
        place = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)
        places.append(np.take_along_axis(place, own[near], axis=1).ravel())
    found = np.sort(np.concatenate(places))
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1 if len(found) else 1


def assigned(rows: DataFrame, cells: Cells, n: int = 1, column: str = "embedding") -> DataFrame:
    """Rows with the cells that their vector is in, or the n that it asks: one row each, column cell."""
    spark = rows.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(cells)  # at most MOST_CELLS vectors

    @F.pandas_udf("array<int>")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(held.value.nearest(_unit(v), n).astype(np.int32).tolist()) if len(v) else pd.Series([], dtype=object)

    return usable(rows, column).withColumn("cell", F.explode(place(column)))


def build(rows: DataFrame, cells: Cells, path: str) -> None:
    """Write every usable row by its cell; a cell that is crowded in the sample is dealt to several tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = np.zeros(len(cells.centroids)) if cells.shares is None else cells.shares
    crowded = {c: int(np.ceil(2 * n * x)) for c, x in enumerate(shares.tolist()) if 2 * n * x > 2}  # fewer than n
    pieces = F.element_at(F.create_map(*[F.lit(x) for pair in crowded.items() for x in pair]), F.col("cell")) if crowded else F.lit(1)
    piece = F.pmod(F.xxhash64(*rows.columns), F.coalesce(pieces, F.lit(1)))
    assigned(rows, cells).repartition(n, "cell", piece).write.mode("overwrite").partitionBy("cell").parquet(path)


class _Best:
    """The rows nearest to each of some questions, of rows that come in blocks."""

    #: Scores of matrix products lie closer than this to those of a plain sum; so far apart, scores differ after rounding.
    NEARLY, APART = 1e-9, 2e-12

    def __init__(self, asked: np.ndarray, k: int, asks: np.ndarray | None):
        self.asked, self.k, self.asks = asked, k, asks
        self.unit, self.size = asked / np.linalg.norm(asked, axis=1, keepdims=True), np.sqrt(self._sums(asked, asked))
        self.low = np.full(len(asked), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _sums(a: np.ndarray, b: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
        """Inner products of rows, added up in the order of the components."""
        out = np.zeros(len(a[i, 0]))
        for c in range(a.shape[1]):
            out += a[i, c] * b[j, c]
        return out

    def take(self, ids: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> None:
        """A block of rows, those of a cell one after the other."""
        # Of equal vectors in a cell the k smallest ids are enough.
        order = np.lexsort((ids, np.unique(rows, axis=0, return_inverse=True)[1].ravel(), cells))
        ids, rows, cells = ids[order], rows[order], cells[order]
        new = np.r_[True, (cells[1:] != cells[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)]
        place = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        ids, rows, cells = ids[place < self.k], rows[place < self.k], cells[place < self.k]
        unit, size = rows / np.linalg.norm(rows, axis=1, keepdims=True), np.sqrt(self._sums(rows, rows))
        starts = [0] if self.asks is None else np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        for start, end in zip(starts, [*starts[1:], len(ids)], strict=True):
            asking = np.arange(len(self.asked)) if self.asks is None else np.flatnonzero(self.asks[cells[start]])
            step = max(1, PRODUCTS // (end - start))
            for s in range(0, len(asking), step):
                i, j = self._close(asking[s : s + step], unit[start:end])
                j = j + start
                self.found.append((i, self._sums(self.asked, rows, i, j) / (self.size[i] * size[j]), ids[j]))
        self.settle()

    def _close(self, asking: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a question and a row that may be among its k nearest."""
        scores = self.unit[asking] @ unit.T
        near = scores >= self.low[asking, None] - self.NEARLY
        if len(unit) > self.k and np.count_nonzero(near) > 2 * self.k * len(asking):
            self.low[asking] = np.maximum(self.low[asking], np.partition(scores, -self.k, axis=1)[:, -self.k])
            near = scores >= self.low[asking, None] - self.NEARLY
        i, j = np.nonzero(near)
        return asking[i], j

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, score, id) of all that may be among the k nearest, in order; equal scores by the smaller id."""
        if len(self.found) > 1:
            i, scores, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
            order = np.lexsort((ids, -scores, i))
            i, scores, ids = i[order], scores[order], ids[order]
            starts = lambda new: np.flatnonzero(new)[np.cumsum(new) - 1]
            for other in (np.r_[True, (i[1:] != i[:-1]) | (scores[1:] != scores[:-1])], None):
                first = starts(np.r_[True, i[1:] != i[:-1]] if other is None else other) if len(i) else i
                place = np.arange(len(i)) - first
                if other is None:
                    self.low[i[place == self.k - 1]] = scores[place == self.k - 1]
                    kept = (place < self.k) | (scores >= self.low[i] - self.APART)
                else:
                    kept = place < self.k
                i, scores, ids = i[kept], scores[kept], ids[kept]
            self.found = [(i, scores, ids)]
        return self.found[0] if self.found else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))


def search(spark: SparkSession, path: str, cells: Cells, asked: DataFrame, ident: str, k: int, every: bool = False) -> DataFrame:
    """(list, ident, score, rank): the k vectors of the index nearest to each vector that asks (list, vector).

    They meet in the cells that a question asks; files of other cells are not read (dynamic partition pruning). Cells, the
    crowded ones in pieces, are dealt to tasks, through which they pass by block; a task holds at most about `QUESTIONS`
    questions and hands on the nearest of its rows. Equal scores go by the smaller id. `every` cell read gives the exact result.
    """
    ship(spark)
    index, questions = spark.read.parquet(path), usable(asked.select("list", "vector"), "vector")
    n = len(cells.centroids) if every else min(cells.probes, len(cells.centroids))
    some = n < len(cells.centroids)
    held = spark.sparkContext.broadcast(cells)  # at most MOST_CELLS vectors

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"cell": pa.array(np.flatnonzero(held.value.asks(_unit(b.column(0).to_numpy(zero_copy_only=False)), n).any(axis=1)), pa.int32())})

    if some:
        index = index.join(F.broadcast(questions.select("vector").mapInArrow(wanted, "cell int").where("cell >= 0").distinct()), "cell", "left_semi")
    sizes = index.groupBy("cell").agg(F.count("*").alias("n")) if some else index.agg(F.lit(0).alias("cell"), F.count("*").alias("n"))
    counts = {r.cell: r.n for r in sizes.collect()}  # at most MOST_CELLS rows
    total, asking = sum(counts.values()), questions.count()
    groups = max(1, -(-asking // QUESTIONS))
    # Every part of the rows sees every question: no more copies of these than there are rows.
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // max(1, asking)))
    if some:
        pieces = spark.createDataFrame([(c, -(-4 * parts * m // total)) for c, m in counts.items()], "cell int, pieces long")
        key = F.xxhash64("cell", F.pmod(F.xxhash64(ident), F.col("pieces")))
        index = index.join(F.broadcast(pieces), "cell")
    else:
        key = F.xxhash64(ident)
    types = dict(index.dtypes) | {f"asked {c}": t for c, t in questions.dtypes}
    kept = types["embedding"] if types["embedding"] == types["asked vector"] else "array<double>"
    order = [F.col(c) for c in ("_task", "_cell", "list", ident, "v")]
    rows = index.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select((F.pmod(key, F.lit(parts)) * groups + F.col("_g")).cast("int").alias("_task"), F.col("cell").cast("int").alias("_cell"), F.lit(None).cast(types["asked list"]).alias("list"), ident, F.col("embedding").cast(kept).alias("v"))
    each = questions.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select((F.col("_p") * groups + F.pmod(F.xxhash64("list"), F.lit(groups))).cast("int").alias("_task"), F.lit(-1).alias("_cell"), "list", F.lit(None).cast(types[ident]).alias(ident), F.col("vector").cast(kept).alias("v"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, held_back, best = [], [], None
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0))
            cell = b.column("_cell").to_numpy()
            q = int((cell < 0).sum())  # questions come first
            if q:
                lists += b.column("list")[:q].to_pylist()
                held_back.append(x[:q])
            if q < len(x) and lists:
                if best is None:
                    a = np.concatenate(held_back)
                    best = _Best(a, k, held.value.asks(a / np.linalg.norm(a, axis=1, keepdims=True), n) if some else None)
                best.take(np.array(b.column(ident)[q:].to_pylist()), x[q:], cell[q:])
        if best is not None:
            i, scores, ids = best.settle()
            yield pa.RecordBatch.from_arrays([pa.array([lists[at] for at in i], schema.field("list").type), pa.array(ids.tolist(), schema.field(ident).type), pa.array(scores, pa.float64())], ["list", ident, "score"])

    dealt = rows.select(*order).unionByName(each.select(*order)).repartitionById(parts * groups, F.col("_task")).sortWithinPartitions("_cell")
    schema = to_arrow_schema(dealt.select("list", ident).schema)
    scored = dealt.mapInArrow(nearest, f"list {types['asked list']}, {ident} {types[ident]}, score double").withColumn("score", F.round("score", 12))
    best = Window.partitionBy("list").orderBy(F.desc("score"), ident)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
