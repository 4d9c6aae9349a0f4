"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; of every `WINDOW` consecutive hashes the least is kept, the rightmost
where several are equal, with its position. Any passage of at least k + window - 1 code points that two texts share
leaves a common hash in both fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import shipped, shuffle_partitions

K, WINDOW = 24, 16
#: Window starts handled at once; longer texts go block by block, so memory does not follow the longest text.
BLOCK = 1 << 17
_BITS = 20
_LOW = np.uint64((1 << _BITS) - 1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))


_UP = _powers(_BASE, BLOCK + 4096)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 4096)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """The rolling hash of each k-gram: a difference of prefix sums, brought to a common power."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _UP[: len(codes)])))
    return _mixed((sums[k:] - sums[:-k]) * _DOWN[: len(codes) - k + 1])


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) that winnowing selects, by position.

    Fewer than k code points: one gram, the whole text. Fewer grams than the window: the least of all. Null or empty:
    nothing.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = min(k, n)
    window = min(window, n - k + 1)
    at, kept = [], []
    for start in range(0, n - k - window + 2, BLOCK):
        grams = _grams(codes[start : start + BLOCK + window + k - 2], k)
        key = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
        low, width = key, 1
        while width < window:
            step = min(width, window - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        at.append((_LOW - (low & _LOW)).astype(np.int64) + start)
        kept.append((low >> np.uint64(_BITS)).astype(np.int64))
    at, kept = np.concatenate(at), np.concatenate(kept)
    new = np.concatenate(([True], at[1:] != at[:-1]))
    return at[new], kept[new]


def digest(at: np.ndarray, hashes: np.ndarray) -> str:
    """Hex digest of a fingerprint, positions included."""
    return hashlib.sha256(np.stack([at, hashes]).tobytes()).hexdigest()[:32]


def likeness(a: frozenset, b: frozenset) -> float:
    """Jaccard likeness of two sets of selected hashes; 1 for two empty ones."""
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(id, positions array<long>, hashes array<long>) of every row; other columns are ignored, repeated rows repeat."""

    def run(batches):
        for b in batches:
            found = [winnow(t.as_py(), k, window) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([y for _, y in found], pa.list_(pa.int64()))], names=["id", "positions", "hashes"])

    return shipped(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, positions array<long>, hashes array<long>")


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, tail) in partitions that hold ascending ids; the row that follows a partition's last one comes as its tail.

    The texts move once. Range bounds are ids of the table, one per partition; the row at a bound also goes to the
    partition before (the first of all to the last), so no task needs more than its own range.
    """
    spark = shipped(docs).sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    key = F.coalesce("id", F.lit(-(1 << 63)))
    ids = rows.select(key.alias("key")).repartitionByRange(shuffle_partitions(spark), "key")
    bounds = np.array(sorted({r.low for r in ids.groupBy(F.spark_partition_id()).agg(F.min("key").alias("low")).collect()}), dtype=np.int64)
    n = max(1, len(bounds))

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        p = np.searchsorted(bounds, ids.to_numpy(), "right") - 1
        return pd.Series(p * 2 + (bounds[p] == ids.to_numpy()))

    one = lambda p, tail: F.struct(p.cast("int").alias("p"), F.lit(tail).alias("tail"))
    own = F.expr("_p div 2")
    to = F.when(F.col("_p") % 2 == 1, F.array(one(own, 0), one((own + n - 1) % n, 1))).otherwise(F.array(one(own, 0)))
    return rows.withColumn("_p", place(key)).select("id", "t", F.explode(to).alias("e")).select("id", "t", "e.p", "e.tail").repartitionById(n, "p").sortWithinPartitions("tail", "id", "t").select("id", "t", "tail")


def op2(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`, see the README for the columns.

    Null texts count as empty. Rows are taken by ascending doc_id, a null one first; rows that repeat a doc_id by
    text. The row after the last is the first; a single row follows itself. An empty table gives an empty result.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        before = None
        for b in batches:
            out = []
            for at, t, tail in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                t = t.as_py()
                found = winnow(t, k, window)
                marks = frozenset(found[1].tolist())
                if before:
                    was_at, was, was_found, was_marks = before
                    new = edited(was, t)
                    new_found = winnow(new, k, window)
                    out.append((was_at, len(was), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), digest(*was_found), digest(*new_found), likeness(was_marks, frozenset(new_found[1].tolist())), likeness(was_marks, marks)))
                before = None if tail else (at, t, found, marks)
                if tail:
                    break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2], strict=True)], names=names)

    return _with_following(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
