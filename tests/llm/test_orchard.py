import hashlib
from math import floor, inf, nan

import numpy as np
import pytest

from spindrift.llm import orchard

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def brute(rows, clusters=8, rounds=10):
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, tuple(floor(1024 * float(np.float32(x))) for x in v)))
    mark = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cs = [list(v) for _, v in sorted(kept, key=mark)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(near(v)[1], []).append(v)
        for k, vs in by.items():
            cs[k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    own = {}
    for _, d, k in found:
        own[k] = own.get(k, 0) + d
    return sorted((str(i), k, d, own[k], sum(own.values()), hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for i, d, k in found)


def result(df):
    return sorted((str(r.vec_id), *r[1:]) for r in df.collect())


def vectors(n, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, rng.standard_normal(64).astype(np.float32).tolist(), 0, "x") for i in range(n)]


@pytest.mark.parametrize("k", [1, 2, 8, 60])
def test_search_finds_the_nearest_and_the_smaller_of_equal_ones(k):
    rng = np.random.default_rng(k)
    centroids = rng.integers(-3, 3, (k, 3))
    points = rng.integers(-4, 4, (3_000, 3))
    near, far, measured = orchard.Orchard(centroids).nearest(points)
    want = ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (far == want.min(axis=1)).all() and (near == want.argmin(axis=1)).all()
    assert measured <= k * len(points)


def test_search_stops_early():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-100_000, 100_000, (200, 4))
    points = centroids[rng.integers(0, 200, 2_000)] + rng.integers(-100, 100, (2_000, 4))
    assert orchard.Orchard(centroids).nearest(points)[2] < 200 * 2_000 * 0.7


def test_odd_rows(spark):
    rows = vectors(40)
    odd = [
        (100, None, 1, None), (101, [], 1, ""), (102, [1.0] * 63, 1, ""), (103, [1.0] * 65, 1, ""), (104, [None] + [1.0] * 63, 1, ""), (105, [nan] + [1.0] * 63, 1, ""), (106, [inf] + [1.0] * 63, 1, ""),
        (107, [0.0] * 64, None, ""), (108, [0.0] * 64, 2, ""), (None, rows[3][1], 0, ""), (3, rows[3][1], 0, ""), (3, rows[4][1], 0, ""), (-7, [-0.0001] * 64, 0, None),
    ]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    assert result(orchard.op11(df)) == brute(rows + odd)


@pytest.mark.parametrize("n", [1, 3, 9])
def test_few_and_equal_vectors(spark, n):
    rows = [(i, [0.5] * 64, 0, "") for i in range(n)]
    got = result(orchard.op11(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and {r[1] for r in got} == {0}


def test_empty_tables(spark):
    for rows in ([], [(1, None, 0, "")]):
        df = orchard.op11(spark.createDataFrame(rows, SCHEMA))
        assert df.collect() == [] and df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_does_not_depend_on_partitions_and_holds_large_values(spark):
    rows = [*vectors(60, 8), (900, [3e38] * 64, 0, ""), (901, [-3e38] * 64, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (result(orchard.op11(df.repartition(n))) for n in (1, 13))
    assert one == many and len(one) == 62


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert result(orchard.op11(df)) == brute(rows)
