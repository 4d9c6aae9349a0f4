import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import lattice


def brute(rows):
    """rows: (vec_id, vector, label) -> {index: (links, component)}"""
    good = [i for i, (d, v, y) in enumerate(rows) if d is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    least = list(range(len(rows)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    links = [0] * len(rows)
    by = {}
    for i in good:
        by.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for at in by.values():
        x = np.array([rows[i][1] for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a in range(len(at)):
            for b in np.flatnonzero(x[a + 1 :] @ x[a] >= lattice.COSINE) + a + 1:
                links[at[a]] += 1
                links[at[b]] += 1
                p, q = sorted((root(at[a]), root(at[b])))
                least[q] = p
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    comp = {}
    for g in groups.values():
        for i in g:
            comp[i] = min((rows[j][0] for j in g if rows[j][0] is not None), default=None)
    return sorted((str(rows[i][0]), links[i], str(comp[i])) for i in range(len(rows)))


def got(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in df.collect())


def planted(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    rows = []
    for i in range(n):
        c = unit(rng.standard_normal(dim))
        for _ in range(rng.integers(1, 7)):
            angle = rng.uniform(0, 0.28)
            other = rng.standard_normal(dim)
            other = unit(other - (other @ c) * c)
            rows.append((len(rows), (np.cos(angle) * c + np.sin(angle) * other).astype(np.float32).tolist(), int(i % 4)))
    return rows


def test_decoding_finds_the_nearest_lattice_point():
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)
    x = np.random.default_rng(1).standard_normal((500, 8)) * 3
    c = lattice.decode(x)
    d = ((x - c) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # the covering radius is 1
    assert (d[:, None] <= ((x[:, None, :] - (c[:, None, :] + lattice.ROOTS)) ** 2).sum(axis=2) + 1e-9).all()
    twice = np.rint(c * 2)
    assert np.allclose(twice, c * 2) and ((twice % 2).sum(axis=1) % 8 == 0).all() and (c.sum(axis=1) % 2 == 0).all()


def pairs_at(dim, n, cosine, rng):
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * o


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_recall_at_the_threshold(dim):
    a, b = pairs_at(dim, 3000, 0.98, np.random.default_rng(2))
    (own_a, probed_a, sketch_a), (own_b, probed_b, sketch_b) = lattice.cells(a), lattice.cells(b)
    meet = (own_a == own_b) | (own_a[:, :, None] == probed_b).any(axis=2) | (own_b[:, :, None] == probed_a).any(axis=2)
    close = ((sketch_a.astype(int) - sketch_b) ** 2).sum(axis=1) <= lattice.limit_of(0.98, dim)
    assert (meet.any(axis=1) & close).mean() > 0.99
    first = lattice.first_cells(own_a, probed_a, own_b, probed_b)
    assert (first == lattice.first_cells(own_b, probed_b, own_a, probed_a)).all()
    some = meet.any(axis=1)
    here = (first[:, None, None] == np.concatenate([own_a[:, :, None], probed_a], axis=2)).any(axis=(1, 2)) & (first[:, None, None] == np.concatenate([own_b[:, :, None], probed_b], axis=2)).any(axis=(1, 2))
    assert here[some].all()


def clouds(mean, n, rng, dim=64):
    """Vectors whose cosines are `mean` on average: all around one direction, as learned embeddings are."""
    c = rng.standard_normal(dim)
    c /= np.linalg.norm(c)
    a = rng.standard_normal((n, dim))
    a -= (a @ c)[:, None] * c
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    return np.sqrt(mean) * c + np.sqrt(1 - mean) * a


@pytest.mark.parametrize("mean,most", [(0.0, 1e-4), (0.6, 1e-3), (0.85, 0.1)])
def test_cells_stay_selective_for_correlated_vectors(spark, mean, most):
    """Shares of all pairs that are compared; links among them are as by brute force."""
    n, rng = 1500, np.random.default_rng(6)
    x = clouds(mean, n, rng)
    own, probed, _ = lattice.cells(x)
    compared = sum(int(((own[:, t][:, None] == own[:, t][None, :]) | (own[:, t][:, None, None] == probed[:, t][None, :, :]).any(axis=2)).sum()) - n for t in range(own.shape[1]))
    assert compared / (n * (n - 1)) < most
    o = clouds(0.0, 100, rng)
    y = x[:100] + 0.12 * o  # near copies
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x[:700], y / np.linalg.norm(y, axis=1, keepdims=True)]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, want = got(lattice.near_vectors(df)), brute(rows)
    links, all_links = sum(r[1] for r in found), sum(r[1] for r in want)
    assert all_links >= 200 and 0.99 * all_links <= links <= all_links


def test_links_against_brute_force(spark):
    rows = planted(3, 400)
    rows += [(len(rows) + i, rows[5][1], rows[5][2]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    whole, dealt = got(lattice.near_vectors(df)), got(lattice.near_vectors(df, group=4, part=3))
    assert whole == dealt and len(whole) == len(want)
    links, all_links = sum(x[1] for x in whole), sum(x[1] for x in want)
    assert 0.99 * all_links <= links <= all_links


def test_dense_cloud_is_counted_whole(spark):
    rng = np.random.default_rng(4)
    c = rng.standard_normal(64)
    rows = [(i, (c + 0.1 * rng.standard_normal(64)).tolist(), 1) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert got(lattice.near_vectors(df, part=100, group=64)) == brute(rows)


def test_ties_right_at_the_threshold_link(spark):
    a = [3.0, 4.0, *[0.0] * 14]
    b = [3.0, -4.0, *[0.0] * 14]  # cosine -7 / 25
    df = spark.createDataFrame([(1, a, 1), (2, b, 1), (3, [x * 2 for x in a], 1), (4, [x * 1e150 for x in a], 1)], "vec_id long, embedding array<double>, label int")
    assert got(lattice.near_vectors(df)) == [("1", 2, "1"), ("2", 0, "2"), ("3", 2, "1"), ("4", 2, "1")]
    limit = float(np.array(a) @ [4.0, 3.0, *[0.0] * 14] / 25)  # 0.96, the very sum that is compared
    two = spark.createDataFrame([(1, a, 1), (2, [4.0, 3.0, *[0.0] * 14], 1)], "vec_id long, embedding array<double>, label int")
    assert [r[1] for r in got(lattice.near_vectors(two, cosine=limit - 1e-12, scale=1.0))] == [1, 1]
    assert [r[1] for r in got(lattice.near_vectors(two, cosine=limit + 1e-12, scale=1.0))] == [0, 0]


def test_edge_cases(spark):
    v = [1.0] * 64
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, None, 1), (5, [0.0] * 64, 1), (6, [float("nan")] * 64, 1), (7, [None] * 64, 1), (8, v, None), (None, v, 1), (9, [], 1), (10, [2.0] * 64, 1), (11, [1.0] * 5, 1), (12, [3.0] * 5, 1), (13, [float("inf")] + v[1:], 1), (14, [1.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    assert got(lattice.op8(df)) == brute(rows)
    assert lattice.op8(df.where(F.lit(False))).count() == 0


def crowd(n, seed):
    """Unit vectors around one, apart only along the sketch's own directions: no sketch tells less than their distance."""
    rng = np.random.default_rng(seed)
    directions = lattice.plan(64)[2]
    c = rng.standard_normal(64)
    c -= directions @ (directions.T @ c)
    x = c / np.linalg.norm(c) + 0.14 * (lambda a: a / np.linalg.norm(a, axis=1, keepdims=True))(rng.standard_normal((n, 8))) @ directions.T
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_no_sketch_parts_a_linked_pair():
    for dim in (4, 8, 64, 384):
        a, b = pairs_at(dim, 2000, 0.98, np.random.default_rng(dim))
        d = lattice.plan(dim)[2] if dim > 8 else None
        if d is not None:  # the difference lies within the sketch
            o = np.random.default_rng(1).standard_normal((2000, 8)) @ d.T
            o -= (o * a).sum(axis=1, keepdims=True) * a
            b = 0.98 * a + np.sqrt(1 - 0.98**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
        x, y = lattice.cells(a, tables=1)[2].astype(int), lattice.cells(b, tables=1)[2]
        assert (((x - y) ** 2).sum(axis=1) <= lattice.limit_of(0.98, dim)).all()


@pytest.mark.parametrize("group", [4])
def test_links_do_not_depend_on_partitions_and_batches(spark, group):
    x = np.concatenate([crowd(60, 1), crowd(9, 2), clouds(0.0, 40, np.random.default_rng(3))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = []
    batch, shuffle = (spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"))
    try:
        for partitions, rows_a_batch in ((1, 7), (3, 100), (20, 10_000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(got(lattice.near_vectors(df.repartition(partitions), group=group)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    assert found[0] == found[1] == found[2]
    links, want = sum(r[1] for r in found[0]), sum(r[1] for r in brute(rows))
    assert want > 100 and 0.98 * want <= links <= want
    # No component joins vectors without links.
    alone = {r[0] for r in found[0] if r[1] == 0}
    assert all(r[2] == r[0] for r in found[0] if r[0] in alone)


def test_many_null_keys_are_dealt(spark):
    from spindrift.llm.common import spread_join

    rows = spark.range(20_000).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 50).alias("k"))
    values = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(rows, values, ["k"], "n", 20_000, "left")
        sizes = [r["count"] for r in joined.where("k is null").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 15_000 and max(sizes) < 4_000
    assert joined.count() == 20_000 and joined.where("n is null and k is not null").count() == 0
