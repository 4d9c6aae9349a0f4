"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits agree to within one bit in at least one 32-bit half. Every
fingerprint therefore emits, for each half, all variants of that half within half the radius (one bit). Both sides of
a linked pair meet on a common variant; the variants are shuffled, equal fingerprints having been folded before, and
colliding pairs are verified on all 64 bits. No candidate is dropped: a variant that gathers more fingerprints than
`GROUP` is dealt anew by the variants of the two quarters of its other half, where the rest of the distance must lie;
what is still crowded then is cut into parts, and every pair of parts is searched in a task of its own.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import hex64, pairs_of_parts, shipped, shuffle_partitions, spread_join, written
from spindrift.llm.graph import connected_components

#: Fingerprints that one variant may gather in a task before they are dealt anew by a finer variant.
GROUP = 32_768
#: Up to this many, a group's pairs are compared at once; above, by a search that emits a forest only.
SMALL = 6

#: For each byte value, its bits spread over the eight bytes of a word: a sum of up to 255 such words counts bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes, of which there is at least one."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 64):
        part = h[at : at + 255 * 64]
        lanes = np.add.reduceat(_SPREAD[part.view(np.uint8).reshape(-1, 8)], np.arange(0, len(part), 255), axis=0)
        counts += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats included; fewer words: the whole sequence; none: zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    return int(majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for every row; a null text has no words, so its fingerprint is zero."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return shipped(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def _variants(width: int, kept: tuple[Column, Column]) -> list[tuple[Column, int, int]]:
    i = F.col("i")
    j = i % (width + 1)
    flip = F.when(j == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, cast(i % {width + 1} - 1 as int))"))
    side = F.expr(f"cast(i div {width + 1} as long)")
    return side * F.lit(1 << width) + F.when(side == 0, kept[0]).otherwise(kept[1]).bitwiseXOR(flip)


def _first(classes: DataFrame) -> DataFrame:
    """Each half of each fingerprint with at most one bit flipped: 66 rows."""
    halves = (F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    return classes.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("i")).select(_variants(32, halves).alias("k0"), F.lit(0).cast("long").alias("k1"), "fp", "rep")


def _second(rows: DataFrame) -> DataFrame:
    """For variants that gathered too many: also the quarters of the other half, at most one bit flipped: 34 rows each.

    The first half of such a pair may differ in any number of bits that its variant allows, so up to three can remain
    for the other half; one of its two quarters then holds at most one of them.
    """
    other = F.when(F.col("k0") < (1 << 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    rest = rows.withColumn("o", other)
    quarters = (F.shiftrightunsigned("o", 16), F.col("o").bitwiseAND(F.lit(0xFFFF)))
    return rest.select("k0", "fp", "rep", "o", F.explode(F.sequence(F.lit(0), F.lit(33))).alias("i")).select("k0", (_variants(16, quarters) + 1).alias("k1"), "fp", "rep")


def balls(rows: DataFrame, fp: str, blocks: int) -> DataFrame:
    """Each row once for every block of its fingerprint and every variant of it within one bit: columns key and flip.

    flip is 0 where the variant is the block itself. Two fingerprints meet on a variant where a block of both differs in
    two bits or fewer, each side going half of the way; of `blocks` blocks one must, within 3 * blocks - 1 bits in all.
    """
    width = 64 // blocks
    each = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(blocks * (width + 1) - 1))))
    block, flip = F.expr(f"cast(_i div {width + 1} as int)"), F.col("_i") % (width + 1)
    value = F.call_function("shiftrightunsigned", F.col(fp), block * width).bitwiseAND(F.lit((1 << width) - 1))
    flipped = F.when(flip == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (flip - 1).cast("int")))
    return each.select((block.cast("long") * F.lit(1 << width) + value.bitwiseXOR(flipped)).alias("key"), flip.cast("byte").alias("flip"), *rows.columns)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, row by row; a row may be several words."""
    n = np.bitwise_count(a ^ b)
    return n if n.ndim == 1 else n.sum(axis=1, dtype=np.int64)


def forest(fp: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of one group's link graph: each fingerprint is searched from once."""
    left, right = [], []
    todo = np.arange(len(fp))
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            near = _apart(fp[todo], fp[at]) <= radius
            if near.any():
                hit, todo = todo[near], todo[~near]
                left.append(np.full(len(hit), at))
                right.append(hit)
                queue.extend(hit)
    return left, right


def links(k0, k1, fp, rep, radius):
    """Edges among sorted rows of whole groups."""
    n = len(fp)
    cuts = np.flatnonzero((k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])) + 1
    starts = np.concatenate(([0], cuts))
    sizes = np.diff(np.append(starts, n))
    left, right = [], []
    for d in range(1, SMALL):
        at = starts[(sizes > d) & (sizes <= SMALL)]
        if not len(at):
            break
        size = sizes[(sizes > d) & (sizes <= SMALL)]
        for o in range(SMALL - d):
            i = at[size > o + d] + o
            near = _apart(fp[i], fp[i + d]) <= radius
            left.append(i[near])
            right.append(i[near] + d)
    for s, m in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        a, b = forest(fp[s : s + m], radius)
        left += [x + s for x in a]
        right += [x + s for x in b]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = rep[np.concatenate(left)], rep[np.concatenate(right)]
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _matcher(radius: int, most: int):
    names = ["a", "b", "k0", "k1", "fp", "rep"]
    kinds = [pa.int64()] * 6

    def edges(a, b):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none, none], names=names)

    def later(rows):
        none = pa.nulls(len(rows[0]), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *map(pa.array, rows)], names=names)

    def run(batches):
        held, over = None, None
        for b in batches:
            rows = [b.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            if over is not None:  # the group that is too large goes on
                same = (rows[0] == over[0]) & (rows[1] == over[1])
                m = len(same) if same.all() else int(np.argmin(same))
                if m:
                    yield later([r[:m] for r in rows])
                    rows = [r[m:] for r in rows]
                if not len(rows[0]):
                    continue
                over = None
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                held = None
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            whole, tail = [r[:cut] for r in rows], [r[cut:] for r in rows]
            if cut:
                yield edges(*links(*whole[:2], whole[2].view(np.uint64), whole[3], radius))
            if len(tail[0]) > most:
                over = (tail[0][0], tail[1][0])
                yield later(tail)
            else:
                held = tail
        if held is not None and len(held[0]):
            yield edges(*links(*held[:2], held[2].view(np.uint64), held[3], radius))

    return run, ", ".join(f"{n} long" for n in names), kinds


def near_pairs(classes: DataFrame, radius: int = 3, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs within `radius` do (radius: 1 to 3).

    classes: one row (fp, rep) per distinct fingerprint; the edges name reps. In a group of more than `SMALL` a
    spanning forest of its links is returned instead of all pairs, so that the rows stay linear in the group.
    """
    run, schema, _ = _matcher(radius, group)
    n = shuffle_partitions(classes.sparkSession)
    found = written(_first(classes).repartition(n, "k0", "k1").sortWithinPartitions("k0", "k1", "fp").mapInArrow(run, schema), "links")
    edges = found.where("a is not null").select("a", "b")
    late = found.where("k0 is not null").select("k0", "fp", "rep")
    if not late.isEmpty():
        more = written(_second(late).repartition(n, "k0", "k1").sortWithinPartitions("k0", "k1", "fp").mapInArrow(run, schema), "links")
        edges = edges.union(more.where("a is not null").select("a", "b"))
        rest = more.where("k0 is not null").select(F.xxhash64("k0", "k1").alias("k0"), "fp", "rep")
        if not rest.isEmpty():
            last, schema, _ = _matcher(radius, 1 << 62)  # a pair of parts has `group` rows at most, about
            parts = pairs_of_parts(rest, "k0", "fp", max(1, group // 2)).select("k0", F.xxhash64("p", "q").alias("k1"), "fp", "rep")
            edges = edges.union(written(parts.repartition(n, "k0", "k1").sortWithinPartitions("k0", "k1", "fp").mapInArrow(last, schema), "links").where("a is not null").select("a", "b"))
    return edges


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3, group: int = GROUP) -> DataFrame:
    """One row (id, fp, component) per row of `docs`: component is the smallest id reachable over links of at most `radius` bits.

    Null or wordless texts have fingerprint zero and link like any other. Repeated rows keep their rows and share an
    id. A row whose id is null keeps its fingerprint, links with nothing and has a null component. Other columns are
    ignored; an empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    labels = connected_components(near_pairs(classes.select("fp", "rep"), radius, group))
    known = written(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "times", F.coalesce("component", "rep").alias("component")), "classes")
    return spread_join(fps, known, ["fp"], "times", fps.count(), "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text and any other columns) without near copies: of each component the smallest doc_id stays.

    Documents link by a Jaccard likeness of 0.8 or more of their five-word shingles. Those that may are found by balls of
    fingerprints as in op1, wider ones, see `likeness`; op1's three words and three bits bind op1 alone. Of rows that repeat a doc_id one stays, that with the least hash of its text. Rows
    without a doc_id all stay.
    """
    from spindrift.llm import likeness

    classes, labels = likeness.components(docs)
    gone = labels.where("node <> component").select(F.col("node").alias("rep"))
    kept = classes.select("rep").distinct().join(gone, "rep", "left_anti").select(F.col("rep").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = docs.join(kept, "doc_id", "left_semi").select(F.struct("*").alias("_row"), "doc_id", F.row_number().over(order).alias("_n")).where("_n = 1").select("_row.*")
    return one.unionByName(docs.where("doc_id is null"))


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of documents; nulls, repeats and empty tables as in `simhash_components`."""
    found = simhash_components(docs)
    return found.select(F.col("id").alias("doc_id"), hex64(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
