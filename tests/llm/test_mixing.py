import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift.llm import mixing


def brute_targets(sizes):
    """sizes: {source: size}; the resharing as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(docs, near):
    rows = docs.select("doc_id", "source", "text").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for r in rows:
        total[r.source] += size(r.text)
    want = brute_targets(total)
    got = mixing.op4(docs).collect()
    assert len(got) == len(rows)
    source = {(r.doc_id, size(r.text)): r.source for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == total[s]
        assert r.target == pytest.approx(want[s], rel=1e-9)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= near * t + 1e-6, s
    assert sorted(map(str, got)) == sorted(map(str, mixing.op4(docs.repartition(5)).collect()))


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0.02)


def test_hot_source_and_hot_class(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 50)
    rows = [(i, "w " * (7 if i % 2 else 1 + i % 13), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.02)


def test_multipliers_solve_the_dual(spark):
    classes = spark.createDataFrame([("a", z, n) for z, n in [(1, 40), (5, 30), (20, 10), (300, 2)]] + [("b", 4, 10)], "source string, size long, n long")
    total = 40 + 150 + 200 + 600
    for goal in (0.2, 0.9, 1.0, 1.3, 1.9, 2.0):
        targets = spark.createDataFrame([("a", total, goal * total), ("b", 40, goal * 40)], "source string, source_size long, target double")
        r = F.least(F.lit(2.0), F.exp(F.col("lam") * F.col("size") / F.col("mean")))
        got = classes.join(mixing.solve(classes, targets), "source").groupBy("source").agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), F.first("target").alias("target")).collect()
        for x in got:
            assert x.got == pytest.approx(x.target, rel=1e-6)


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, size int"
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "a", 1), (3, "one two", "a", 1), (3, "one two", "a", 1), (None, "x " * 100_000, None, 2), (5, " \t ", "empty", 0)], schema)
    got = mixing.op4(docs).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == [(0, 100_000), (1, 0), (2, 0), (3, 2), (3, 2), (5, 0)]
    assert all(r.taken <= 2 * r["size"] for r in got)
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 5}
    assert mixing.op4(docs.where(F.lit(False))).count() == 0


def test_mixed_repeats_as_counted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copies = {r.doc_id: r.taken // r["size"] for r in mixing.op4(docs).collect() if r["size"]}
    got = defaultdict(int)
    for r in mixing.mixed(docs).select("doc_id").collect():
        got[r.doc_id] += 1
    assert {d: n for d, n in copies.items() if n} == {d: n for d, n in got.items() if d in copies}


def test_sources_take_the_weights_in_order(spark):
    names = [None, "", "Z", "a", "é", *(f"s{i:03d}" for i in range(120))]
    df = spark.createDataFrame([(n, 10) for n in names], "source string, source_size long")
    got = {r.source: r.weight for r in mixing._placed(df, mixing.WEIGHTS).collect()}
    order = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert got == {n: mixing.WEIGHTS[i % 3] for i, n in enumerate(order)}
