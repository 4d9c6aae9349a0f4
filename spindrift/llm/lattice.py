"""Near-duplicate embeddings by lattice hashing.

Unit vectors are rotated at random and cut into blocks of eight coordinates; the blocks of a table, decoded to points of
the E8 lattice, make the vector's cell there. A vector also probes the cells behind its nearest walls. Two vectors meet
in a cell if it is the own cell of at least one of them. Eight further coordinates bound the distance of two vectors from
below: only those that they do not part go on, with their components, to an exact comparison inside the cell. A pair is
counted and linked in the first cell where it meets, so results depend on the vectors alone.

Equal vectors are folded into one before. A cell of any size is split into parts; every pair of parts is one piece of
work of bounded size, so a crowded cell is spread over many tasks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import forget, pairs_of_parts, shipped, shuffle_partitions, spread_join, written
from spindrift.llm.graph import connected_components

COSINE = 0.98
#: Tables, blocks of eight coordinates in a table's cell, cells probed besides the own one, and the lattice's scale
#: against unit vectors of 64 components.
TABLES, BLOCKS, PROBES, SCALE = 10, 4, 4, 0.25
#: Rows of a cell that are searched by those coordinates (all rows of a larger cell go on, which loses and adds no link);
#: rows in a part of a cell.
GROUP, PART = 512, 1_024
SEED = 20_240_801


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, by the rule that makes them."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    halves = (np.arange(256)[:, None] >> np.arange(8) & 1) - 0.5
    return np.concatenate([np.array(out), halves[(halves < 0).sum(axis=1) % 2 == 0]])


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    off = x[odd] - r[odd]
    worst = np.abs(off).argmax(axis=1)
    r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the nearer one of D8 and D8 shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


def _hashed(points: np.ndarray, salt: int) -> np.ndarray:
    mult = np.random.default_rng(SEED + 1000 + salt).integers(1, 1 << 62, points.shape[1], dtype=np.int64).astype(np.uint64) | np.uint64(1)
    h = ((points * 2).astype(np.int64).astype(np.uint64) * mult).sum(axis=1, dtype=np.uint64) + np.uint64(salt)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def plan(dim: int, tables: int = TABLES, blocks: int = BLOCKS):
    """Projection (dim, tables * blocks * 8), offsets, and eight orthogonal directions, the same on every executor."""
    rng = np.random.default_rng([SEED, dim])
    need, wide = tables * blocks * 8, []
    turn = lambda: np.linalg.qr(rng.standard_normal((max(dim, 8), max(dim, 8))))[0][:dim]
    while sum(w.shape[1] for w in wide) < need:
        wide.append(turn())
    return np.concatenate(wide, axis=1)[:, :need], rng.random((need,)) * 2, turn()[:, :8]


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE):
    """(own cells (n, tables), probed cells (n, tables, probes), sketch (n, 8) of small integers).

    Probes step over the nearest walls: over one of the two nearest of one block, or over one each of two blocks,
    whichever are least far away.
    """
    proj, offset, signs = plan(unit.shape[1], tables, blocks)
    wide = np.sqrt(64 / unit.shape[1])  # a block's share of a distance falls with the length
    x = (unit @ proj) / (scale * wide) + offset
    n = len(unit)
    own, probed = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    ways = [(i,) for i in range(2 * blocks)] + [(i, j) for i, j in combinations(range(2 * blocks), 2) if i // 2 != j // 2]
    for t in range(tables):
        here, beyond, gap = [], [], []
        for b in range(blocks):
            y = x[:, (t * blocks + b) * 8 : (t * blocks + b + 1) * 8]
            c = decode(y)
            toward = (y - c) @ ROOTS.T  # at 1 the wall is reached
            here.append(c)
            for _ in range(2):
                first = toward.argmax(axis=1)
                beyond.append(c + ROOTS[first])
                gap.append(np.maximum(1 - toward[np.arange(n), first], 0))
                toward[np.arange(n), first] = -np.inf
        own[:, t] = _hashed(np.concatenate(here, axis=1), t)
        far = np.stack([sum(gap[i] ** 2 for i in way) for way in ways], axis=1)
        best = np.argsort(far, axis=1, kind="stable")[:, :probes]
        points = np.stack(here, axis=1)
        for p in range(probes):
            moved = points.copy()
            for w in np.unique(best[:, p]):
                at = np.flatnonzero(best[:, p] == w)
                for i in ways[w]:
                    moved[at, i // 2] = beyond[i][at]
            probed[:, t, p] = _hashed(moved.reshape(n, -1), t)
    sketch = np.clip(np.rint((unit @ signs) / wide * 127), -127, 127).astype(np.int8)
    return own, probed, sketch


def limit_of(cosine: float, dim):
    """Most that the squared distance of a linked pair's sketches can be; `dim` may be a column.

    A projection on orthogonal directions lengthens nothing, nor does clipping; rounding moves each of the eight
    coordinates of a difference by one at most.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) * 127 * (1 + 1e-9)
    root = (F.sqrt(dim / 64.0) if not isinstance(dim, (int, float)) else float(np.sqrt(dim / 64.0))) * reach + float(np.sqrt(8))
    return root * root + 1e-6


def _units(vectors: pa.Array) -> np.ndarray:
    """Unit vectors of lists of one length."""
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # very large and very small components square without overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel(), kind))


def _hash_rows(tables: int, blocks: int, probes: int, scale: float):
    names = ["rep", "times", "label", "embedding", "own", "probed", "sketch"]

    def run(batches):
        for b in batches:
            dims = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for s in range(0, len(at), 1000):
                    part = b.take(pa.array(at[s : s + 1000]))
                    own, probed, sketch = cells(_units(part.column("embedding")), tables, blocks, probes, scale)
                    # Cells of one label and length only: these change the hash.
                    salt = (part.column("label").to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)) * np.uint64(0xBF58476D1CE4E5B9)
                    own = (own.view(np.uint64) + salt[:, None]).view(np.int64)
                    probed = (probed.view(np.uint64) + salt[:, None, None]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:4]), _list(own, pa.int64()), _list(probed, pa.int64()), pa.array(np.ascontiguousarray(sketch).view(np.int64).ravel())], names=names)

    return run


def _meeting(k: np.ndarray, own: np.ndarray, sketch: np.ndarray, limit: np.ndarray, most: int) -> np.ndarray:
    """Which of the sorted rows of whole cells meet another that is close, one of the two being at home; in a cell of more
    than `most` rows all."""
    n = len(k)
    starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows of the cell from here on
    codes = sketch.view(np.int8).reshape(n, 8).astype(np.int32)
    out = np.repeat(sizes > most, sizes)
    at = np.flatnonzero(~out)
    for d in range(1, int(sizes[sizes <= most].max(initial=0))):
        at = at[left[at] > d]
        i = at[own[at] | own[at + d]]
        near = ((codes[i] - codes[i + d]) ** 2).sum(axis=1) <= limit[i]
        out[i[near]] = out[i[near] + d] = True
    return out


def _search(most: int):
    """The rows of sorted cells that meet a close one; of a cell with more than `most` rows, all."""
    names = ["k", "rep", "own"]

    def out(rows, keep):
        return pa.RecordBatch.from_arrays([pa.array(rows[0][keep]), pa.array(rows[1][keep]), pa.array(rows[2][keep])], names=names)

    def run(batches):
        held, over = None, None
        for b in batches:
            rows = [b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "rep", "own", "sketch", "lim")]
            if over is not None:
                same = rows[0] == over
                m = len(same) if same.all() else int(np.argmin(same))
                if m:
                    yield out(rows, slice(0, m))
                    rows = [r[m:] for r in rows]
                if not len(rows[0]):
                    continue
                over = None
            if held is not None:
                rows, held = [np.concatenate(x) for x in zip(held, rows, strict=True)], None
            last = np.flatnonzero(rows[0] != rows[0][-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield out([r[:cut] for r in rows], _meeting(rows[0][:cut], *[r[:cut] for r in rows[2:]], most))
            tail = [r[cut:] for r in rows]
            if len(tail[0]) > most:
                over = tail[0][0]
                yield out(tail, slice(None))
            else:
                held = tail
        if held is not None and len(held[0]):
            yield out(held, _meeting(held[0], *held[2:], most))

    return run, "k long, rep long, own boolean"


def first_cells(own_a, probed_a, own_b, probed_b) -> np.ndarray:
    """For each pair the cell in which it is counted: in its first table with a cell at home for one, the lesser of such cells."""
    n, tables = own_a.shape
    out, todo = np.zeros(n, np.int64), np.arange(n)
    for t in range(tables):
        x, y = own_a[todo, t], own_b[todo, t]
        in_x = (x == y) | (x[:, None] == probed_b[todo, t]).any(axis=1)
        in_y = (x == y) | (y[:, None] == probed_a[todo, t]).any(axis=1)
        top = np.iinfo(np.int64).max
        found = in_x | in_y
        out[todo[found]] = np.minimum(np.where(in_x, x, top), np.where(in_y, y, top))[found]
        todo = todo[~found]
        if not len(todo):
            break
    return out


def _forest(near: np.ndarray, same: bool):
    """Edges (row, column) that connect what `near` connects; breadth first, rows and columns being the two sides."""
    todo_a, todo_b = near.any(axis=1), near.any(axis=0)
    left, right = [], []
    for root in np.flatnonzero(todo_a):
        if not todo_a[root]:
            continue
        todo_a[root] = False
        if same:
            todo_b[root] = False
        queue = [(0, root)]
        while queue:
            s, x = queue.pop()
            hit = np.flatnonzero(near[x] & todo_b) if s == 0 else np.flatnonzero(near[:, x] & todo_a)
            if not len(hit):
                continue
            (todo_b if s == 0 else todo_a)[hit] = False
            if same:
                todo_a[hit] = False
            left.append(np.full(len(hit), x) if s == 0 else hit)
            right.append(hit if s == 0 else np.full(len(hit), x))
            queue += [(0 if same else 1 - s, int(h)) for h in hit]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _exact(cosine: float):
    """Counts and edges of linked pairs of each cell's pairs of parts, given sorted by (k, p, q)."""
    names = ["rep", "n", "other"]

    def batch(rep, n, other):
        return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.nulls(len(rep), pa.int64()) if n is None else pa.array(n, pa.int64()), pa.nulls(len(rep), pa.int64()) if other is None else pa.array(other, pa.int64())], names=names)

    def work(g: pa.Table):
        g = g.combine_chunks()
        col = {c: g.column(c).combine_chunks() for c in g.column_names}
        num = {c: col[c].to_numpy(zero_copy_only=False) for c in ("rep", "times", "side", "own", "label")}
        k, same = col["k"][0].as_py(), col["p"][0].as_py() == col["q"][0].as_py()
        a = np.flatnonzero(num["side"] == 0)
        b = a if same else np.flatnonzero(num["side"] == 1)
        if not len(a) or not len(b):
            return
        unit = _units(col["embedding"])
        near = np.zeros((len(a), len(b)), bool)
        for s in range(0, len(a), 256):
            near[s : s + 256] = unit[a[s : s + 256]] @ unit[b].T >= cosine
        near &= num["own"][a][:, None] | num["own"][b][None, :]
        near &= num["label"][a][:, None] == num["label"][b][None, :]
        if same:
            near &= np.triu(np.ones(near.shape, bool), 1)
        i, j = np.nonzero(near)
        if not len(i):
            return
        shape = (len(unit), -1)
        own = col["cells"].flatten().to_numpy().reshape(shape)
        probed = col["probed"].flatten().to_numpy().reshape(len(unit), own.shape[1], -1)
        counts, linked = np.zeros(len(unit)), np.zeros(near.shape, bool)
        for s in range(0, len(i), 1 << 16):
            x, y = a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]]
            mine = first_cells(own[x], probed[x], own[y], probed[y]) == k
            counts += np.bincount(x[mine], num["times"][y[mine]], len(unit)) + np.bincount(y[mine], num["times"][x[mine]], len(unit))
            linked[i[s : s + (1 << 16)][mine], j[s : s + (1 << 16)][mine]] = True
        some = np.flatnonzero(counts)
        yield batch(num["rep"][some], np.rint(counts[some]).astype(np.int64), None)
        x, y = _forest(linked | linked.T if same else linked, same)
        yield batch(num["rep"][a[x]], None, num["rep"][b[y]])

    def pieces(held: list):
        t = pa.Table.from_batches(held)
        lengths = t.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):  # more than one only where hashes collide
            part = t if (lengths == dim).all() else t.take(pa.array(np.flatnonzero(lengths == dim)))
            yield from work(part)

    def run(batches):
        key, held = None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "p", "q")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                now = tuple(keys[:, s])
                if now != key:
                    if held:
                        yield from pieces(held)
                    key, held = now, []
                held.append(b.slice(s, e - s))
        if held:
            yield from pieces(held)

    return run, "rep long, n long, other long"


def hashed_vectors(classes: DataFrame, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """classes (rep, times, label, embedding) with their own and probed cells and their sketch."""
    run = _hash_rows(tables, blocks, probes, scale)
    kind = dict(classes.dtypes)["embedding"]
    return shipped(classes).select("rep", "times", "label", "embedding").mapInArrow(run, f"rep long, times long, label long, embedding {kind}, own array<long>, probed array<long>, sketch long")


def meetings(hashed: DataFrame, cosine: float = COSINE, group: int = GROUP) -> DataFrame:
    """(k, rep, own): the rows of each cell that may link with another row of it."""
    limit = limit_of(cosine, F.size("embedding"))
    each = F.concat(F.transform("own", lambda c: F.struct(c.alias("k"), F.lit(True).alias("own"))), F.transform("probed", lambda c: F.struct(c.alias("k"), F.lit(False).alias("own"))))
    rows = hashed.select("rep", "sketch", limit.alias("lim"), F.explode(each).alias("c")).select("c.k", "rep", "c.own", "sketch", "lim")
    search, schema = _search(group)
    n = shuffle_partitions(hashed.sparkSession)
    return rows.repartition(n, "k").sortWithinPartitions("k", F.desc("own"), "rep").mapInArrow(search, schema)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, group: int = GROUP, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of `vectors` (vec_id, embedding, label).

    Vectors link only within one label and length. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null label or vec_id, link with nothing: no links, a component of their own. Rows that
    repeat a vec_id count as vectors of their own and share a component id. A cosine right at the limit links; equal
    vectors always do. An empty table gives an empty result.
    """
    real = (
        F.col("embedding").isNotNull()
        & F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"), F.coalesce(real, F.lit(False)).alias("_real"))
    tag = F.when(F.col("_real"), F.sha2(F.to_json(F.struct("label", "embedding")), 256))
    rows = written(rows.withColumn("_class", tag), "vectors")
    # Two labels may hold one vec_id: classes are told apart by a number of their own.
    classes = rows.where("_real").groupBy("_class").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("rep", F.xxhash64("_class"))
    n = shuffle_partitions(vectors.sparkSession)
    known = written(classes, "classes")
    hashed = written(hashed_vectors(known.repartition(n, "rep"), tables, blocks, probes, scale), "hashed")
    met = written(meetings(hashed, cosine, group), "meetings")
    dealt = pairs_of_parts(met, "k", "rep", part).join(hashed.withColumnRenamed("own", "cells").drop("sketch"), "rep")
    exact, schema = _exact(cosine)
    found = written(dealt.repartition(n, "k", "p", "q").sortWithinPartitions("k", "p", "q", "side", "rep").mapInArrow(exact, schema), "exact")
    counts = found.where("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("other is not null"), "rep", "other").withColumnRenamed("node", "rep")
    labelled = written(known.select("_class", "rep", "least", "times").join(counts, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled")
    for done in (hashed, met, found):
        forget(done)
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_rows"))
    own = spread_join(labelled, least, ["component"], "_rows", labelled.count())
    final = written(own.select("_class", "times", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"), "final")
    joined = spread_join(rows.select("vec_id", "_class"), final, ["_class"], "times", rows.count(), "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op8(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings; nulls, repeats and empty tables as in `near_vectors`."""
    return near_vectors(vectors).select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"))
