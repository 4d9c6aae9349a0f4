"""Centroid clustering: Lloyd rounds whose nearest centroids are found by Orchard search.

Each centroid has the list of all others by growing distance. A vector walks the list of its current centroid; where a
closer one is met it jumps to that one's list, centroids met before are not measured again, and the walk stops at the
first centroid that lies strictly beyond twice the current distance, as nothing from there on can be as near (triangle
inequality). All arithmetic is in integers, so results do not depend on partitions or on the order of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import forget, shipped, written

#: Components of a vector, clusters, rounds, and steps a component's unit is cut into.
DIM, CLUSTERS, ROUNDS, STEPS = 64, 8, 10, 1024
#: Integer components are held within this bound (131,072 for 1,024 steps), so that squared distances fit in a long.
BOUND = 1 << 27
#: Vectors that walk together.
AT_ONCE = 8_192


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Orchard:
    """Sorted neighbour lists of centroids (k, dim) of integers."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, k = centroids, len(centroids)
        apart = np.stack([squared(centroids, c) for c in centroids])
        ids = np.arange(k)
        order = np.stack([np.lexsort((ids, np.where(ids == c, -1, apart[c])))[1:] for c in ids])  # all but the centroid itself
        self.lists, self.apart = order, np.take_along_axis(apart, order, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, the smaller one on ties; squared distance; distances measured)."""
        n, k = len(vectors), len(self.centroids)
        best = np.zeros(n, np.int64)
        dist = squared(vectors, self.centroids[0])
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        place, walking, measured = np.zeros(n, np.int64), np.arange(n), n
        while len(walking):
            walking = walking[place[walking] < k - 1]
            # Strictly beyond twice the distance: four times in squares, compared without multiplying up.
            beyond = (self.apart[best[walking], place[walking]] + 3) // 4 > dist[walking]
            walking = walking[~beyond]
            met = self.lists[best[walking], place[walking]]
            place[walking] += 1
            new = ~visited[walking, met]
            at, met = walking[new], met[new]
            visited[at, met] = True
            measured += len(at)
            there = squared(vectors[at], self.centroids[met])
            closer = (there < dist[at]) | ((there == dist[at]) & (met < best[at]))
            jump = at[closer]
            best[jump], dist[jump], place[jump] = met[closer], there[closer], 0
        return best, dist, measured


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def quantised(vectors: DataFrame, dim: int = DIM, steps: int = STEPS) -> DataFrame:
    """(vec_id, v): vectors with exactly `dim` components, none null or not finite, as integers floor(steps * x)."""
    good = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * float(steps)), F.lit(-BOUND)), F.lit(BOUND)).cast("int"))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def starts(rows: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors of the `clusters` smallest sha256 of `3:<vec_id>`, in that order (repeats of an id by components)."""
    mark = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.orderBy(mark, "v").limit(clusters).select("v").collect()], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next round's centroids: exact floor of the mean of each one's vectors; those without vectors stay."""
    k, dim = centroids.shape

    def add(batches):
        orchard, sums, counts = Orchard(centroids), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        seen = 0

        def out():
            cluster, place = np.nonzero(np.broadcast_to(counts[:, None] > 0, (k, dim)))
            return pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[cluster, place]), pa.array(counts[cluster])], names=["cluster", "place", "total", "n"])

        for b in batches:
            v = _matrix(b.column("v"))
            for s in range(0, len(v), AT_ONCE):
                part = v[s : s + AT_ONCE]
                near = orchard.nearest(part)[0]
                counts += np.bincount(near, minlength=k)
                for c in np.unique(near):
                    sums[c] += part[near == c].sum(axis=0)
            seen += len(v)
            if seen > 1 << 34:  # sums stay within a long
                yield out()
                sums[:], counts[:], seen = 0, 0, 0
        yield out()

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = shipped(rows).select("v").mapInArrow(add, "cluster int, place int, total long, n long").groupBy("cluster", "place").agg(exact("total"), exact("n"))
    new = centroids.copy()
    for r in found.collect():  # a row for each centroid and component
        new[r.cluster, r.place] = int(r.total) // int(r.n)
    return new


def clustered(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every row of `rows` (vec_id, v), final centroids); at least one row must be there.

    A round's centroids depend on those before and on exact sums alone; the driver holds clusters x components numbers.
    """
    centroids = starts(rows, clusters)
    for _ in range(rounds):
        new = moved(rows, centroids)
        if (new == centroids).all():
            break  # further rounds change nothing
        centroids = new

    def assign(batches):
        orchard = Orchard(centroids)
        for b in batches:
            v = _matrix(b.column("v"))
            found = [orchard.nearest(v[s : s + AT_ONCE]) for s in range(0, len(v), AT_ONCE)]
            if found:
                near, far = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return shipped(rows).select("vec_id", "v").mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def op11(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept.

    Vectors that are null, of another length, or hold null or non-finite components are not kept. Rows that repeat a
    vec_id are vectors of their own; a null vec_id is kept and hashes as an empty one. With fewer kept vectors than
    clusters each starts one. Equal distances go to the smaller number, so of equal centroids the later stay empty and
    where they are. Integers are held within `BOUND`. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors), "quantised")
    if rows.isEmpty():
        return spark.createDataFrame([], RESULT)
    found, centroids = clustered(rows, clusters, rounds)
    labelled = written(found, "clustered")
    forget(rows)
    exact = {r.cluster: int(r.total) for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = spark.createDataFrame([(c, exact.get(c, 0), sum(exact.values()), m) for c, m in enumerate(marks)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL: every round measures all centroids."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (r.v[i] - c.v[i]) * (r.v[i] - c.v[i])))"
    near = lambda k: f"select r.n, r.vec_id, r.v, arg_min(struct_pack(k := c.k, d := cast({far} as bigint), v := c.v), cast({far} as bigint) * {clusters} + c.k) as b from kept r, c{k} c group by r.n, r.vec_id, r.v"
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} as materialized ({near(k)})")
        steps.append(
            f"s{k} as (select k, i, cast((s - ((s % m + m) % m)) // m as bigint) as x from (select b.k as k, i, sum(v[i]) as s, cast(count(*) as hugeint) as m from a{k}, (select unnest(range(1, 65)) as i) group by all)), "
            f"c{k + 1} as materialized (select c.k, coalesce(any_value(s.v), any_value(c.v)) as v from c{k} c left join (select k, list(x order by i) as v from s{k} group by k) s on s.k = c.k group by c.k)"
        )
    return f"""
with kept as materialized (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
  select row_number() over (order by sha256('3:' || vec_id)) - 1 as k, v from kept order by sha256('3:' || vec_id) limit {clusters}
), {", ".join(steps)}, final as materialized ({near(rounds)})
select vec_id, cast(b.k as integer) as cluster, b.d as distance, cast(sum(b.d) over (partition by b.k) as bigint) as cluster_inertia,
       cast(sum(b.d) over () as bigint) as inertia, sha256(array_to_string(b.v, ',')) as centroid_sha256
from final
"""


ORACLE = _oracle()
