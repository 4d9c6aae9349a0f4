"""Trigram postings and vectors by cell, against whole scans."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.operators import documents, postings, vectorindex
from spindrift.plans.views import view

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERY = "the and of that"


def scanned(rows, query, least=0.0):
    like = text.likeness_to(text.trigrams(F.col("text")), query)
    return {r.id: round(r.x, 9) for r in rows.select("id", like.alias("x")).where((F.col("x") >= least) & (F.col("x") > 0)).collect()}


@pytest.fixture
def rows(spark):
    return view(spark, SF, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("text")).unionByName(spark.createDataFrame([(90001, None), (90002, ""), (90003, "the and"), (90004, "中文 the")], "id long, text string"))


def test_matches_equal_a_scan(spark, rows, tmp_path):
    path = f"file://{tmp_path}/grams"
    postings.build(rows, path)
    index = postings.load(spark, path)
    for query, least in ((QUERY, 0.0), (QUERY, 0.2), ("x", 0.0), ("中文", 0.3), ("...", 0.0)):
        got = {r.id: round(r.likeness, 9) for r in postings.matches(index, query, least).collect()}
        assert got == (scanned(rows, query, least) if text.gram_list(query) else {})
    want = sorted(scanned(rows, QUERY).items(), key=lambda x: (-x[1], x[0]))[:15]
    assert [(r.id, round(r.likeness, 9)) for r in postings.top(index, QUERY, 15).orderBy("rank").collect()] == want
    assert postings.bound(index, QUERY, 15) > 0 and postings.bound(index, QUERY, 15) <= want[-1][1] + 1e-9


def test_only_the_files_of_the_query_are_read(spark, rows, tmp_path):
    path = f"file://{tmp_path}/grams"
    postings.build(rows, path)
    found = postings.matches(postings.load(spark, path), "the", 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "In(gram" in plan and "LessThanOrEqual(size" in plan
    assert len({f.split("bucket=")[1].split("/")[0] for f in postings.load(spark, path).where(F.col("bucket").isin(*range(postings.BUCKETS))).inputFiles()}) > 4
    read = {r.b for r in postings.load(spark, path).where(F.col("bucket").isin(3)).select(F.regexp_extract(F.input_file_name(), r"bucket=(\d+)", 1).alias("b")).collect()}
    assert read == {"3"}


def test_update_makes_changed_blocks_anew_only(spark, rows, tmp_path):
    path = f"file://{tmp_path}/grams"
    before = rows.cache()
    postings.build(before, path)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "grams").rglob("*.parquet")}
    changed = spark.createDataFrame([(1,), (90003,), (95000,)], "id long")
    after = before.where("id <> 1").withColumn("text", F.when(F.col("id") == 90003, "wholly other words").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(95000, QUERY)], "id long, text string"))
    postings.update(after, changed, path)
    index = postings.load(spark, path)
    assert {r.id: round(r.likeness, 9) for r in postings.matches(index, QUERY).collect()} == scanned(after, QUERY)
    assert {r.id for r in postings.matches(index, "wholly other words", 0.9).collect()} == {90003}
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "grams").rglob("*.parquet")}
    same = {str(p).split("block=")[1].split("/")[0] for p in stamps if now.get(p) == stamps[p]}
    assert len(same) >= postings.BLOCKS - 3
    postings.update(after, changed.limit(0), path)
    assert {p for p in (tmp_path / "grams").rglob("*.parquet")} == set(now)


def test_places_come_back():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(5_000_000) < share) for share in (1e-6, 1e-5, 1e-3)] + [np.array(x) for x in ([0], [254], [255], [256, 256 + 0xFFFF], [1 << 23, (1 << 23) + 255, (1 << 23) + 510])]
    gaps = np.concatenate([np.diff(r, prepend=0) for r in rows])
    held = postings._packed(gaps, np.cumsum([0, *map(len, rows)])[:-1])
    assert all(postings._places(b"\0" + h, 5_000_000).tolist() == r.tolist() for h, r in zip(held, rows, strict=True))
    assert postings._places(b"\1" + np.packbits([1, 0, 1, 1, 0, 0, 0, 0, 0, 1]).tobytes(), 10).tolist() == [0, 2, 3, 9]


def test_trigrams_of_arrays_are_those_of_expressions(spark):
    texts = [None, "", " ", "...", "a", "the The", "中文 the", "1 22 333 a", "x" * 500, "".join(chr(c) for c in range(33, 700)), "".join(f"{chr(c)}b " for c in range(0x4E00, 0x5000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1).orderBy("id").select(text.set_apart(F.col("text")).alias("t"), text.trigrams(F.col("text")).alias("g")).collect()
    for some in (rows, rows[:9]):
        size, grams, names = postings._grams([r.t for r in some])
        assert [sorted(names[i] for i in part) for part in np.split(grams, np.cumsum(size)[:-1])] == [sorted(r.g) for r in some]


def test_runs_of_any_length_say_the_same(spark, rows, tmp_path):
    for run in (1, 3_000, 1 << 30):
        path = f"file://{tmp_path}/grams{run}"
        postings._write(postings.postings(rows.coalesce(2), 4, 2, run), path, 8)
        index = postings.load(spark, path)
        assert {r.id: round(r.likeness, 9) for r in postings.matches(index, QUERY, 0.1, 4).collect()} == scanned(rows, QUERY, 0.1)


def test_index_is_smaller_than_the_texts(spark, tmp_path):
    texts = view(spark, SF, "d_chunks").select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    postings.build(texts, f"file://{tmp_path}/grams", 4, 2)
    size = sum(p.stat().st_size for p in (tmp_path / "grams").rglob("*.parquet"))
    assert size < texts.agg(F.sum(F.octet_length("text"))).first()[0]


def test_recall_and_exactness_of_cells(spark, tmp_path):
    rows = view(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    cells, path = vectorindex.learned(rows, "vec_id"), f"file://{tmp_path}/cells"
    vectorindex.build(rows, cells, path)
    assert spark.read.parquet(path).count() == vectorindex.usable(rows).count()
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("list"), F.col("embedding").alias("vector"))
    by_list = lambda df: {k: [r.vec_id for r in sorted(g, key=lambda r: r["rank"])] for k, g in group(df.collect()).items()}

    def group(found):
        out = {}
        for r in found:
            out.setdefault(r["list"], []).append(r)
        return out

    exact = by_list(vectorindex.search(spark, path, cells, asked, "vec_id", 10, every=True))
    good = [(r.vec_id, np.array(r.embedding, float)) for r in vectorindex.usable(rows).collect()]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    ids = np.array([i for i, _ in good])
    for i, v in good:
        if i % 100 == 0:
            scores = np.round(x @ (v / np.linalg.norm(v)), 12)
            assert exact[i] == ids[np.lexsort((ids, -scores))[:10]].tolist()
    some = by_list(vectorindex.search(spark, path, cells, asked, "vec_id", 10))
    recall = np.mean([len(set(some[k]) & set(exact[k])) / len(exact[k]) for k in exact])
    assert 1 <= cells.probes < len(cells.centroids) and recall >= 0.9


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    heads = rng.standard_normal((40, 16))
    rows = spark.createDataFrame([(i, (heads[i % 40] + 0.2 * rng.standard_normal(16)).tolist()) for i in range(4_000)], "vec_id long, embedding array<double>")
    cells, path = vectorindex.learned(rows, "vec_id"), f"file://{tmp_path}/cells"
    vectorindex.build(rows, cells, path)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("list"), F.col("embedding").alias("vector"))
    pairs = lambda every: {(r["list"], r.vec_id) for r in vectorindex.search(spark, path, cells, asked, "vec_id", 10, every).collect()}
    exact, some = pairs(True), pairs(False)
    assert cells.probes <= len(cells.centroids) // 4 and len(exact & some) >= 0.9 * len(exact)
    plan = vectorindex.search(spark, path, cells, asked, "vec_id", 10)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_odd_vectors_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 2.0]), (7, [1.0, 0.1])], "vec_id long, embedding array<double>")
    cells, path = vectorindex.learned(rows, "vec_id", 2), f"file://{tmp_path}/cells"
    vectorindex.build(rows, cells, path)
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "list long, vector array<double>")
    got = vectorindex.search(spark, path, cells, asked, "vec_id", 2, every=True).orderBy("rank").collect()
    assert [(r["list"], r.vec_id) for r in got] == [(0, 1), (0, 7)]
    assert len(vectorindex.learned(rows.limit(0), "vec_id").centroids) == 0


def crowded(n, size, seed=11):
    """Vectors of which every fifth is the same one."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size)).astype(np.float32)
    x[::5] = x[0]
    return x


def brute(x, ids, asked, k, among=None):
    """(list, id, rank) by plain sums; `among`: for each that asks the rows that count."""
    sums = lambda a, b: sum((a[:, c] * b[:, c] for c in range(a.shape[1])), np.zeros(len(a)))
    x, out = x.astype(float), set()
    for i in asked:
        q = np.repeat(x[i : i + 1], len(x), axis=0)
        score = np.round(sums(x, q) / (np.sqrt(sums(x, x)) * np.sqrt(sums(q, q))), 12)
        rows = [j for j in np.lexsort((ids, -score)) if among is None or among[i][j]][:k]
        out |= {(int(ids[i]), int(ids[j]), r + 1) for r, j in enumerate(rows)}
    return out


def test_search_by_blocks_is_exact_over_groups_of_questions_and_crowds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "QUESTIONS", 40)
    x, ids = crowded(1_500, 8), np.arange(1_500) * 3
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    cells, path = vectorindex.learned(rows, "vec_id"), f"file://{tmp_path}/cells"
    vectorindex.build(rows, cells, path)
    asked, own = np.arange(0, 1_500, 9), cells.nearest(x / np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1)[:, 0]
    questions = rows.where("vec_id % 27 = 0").select(F.col("vec_id").alias("list"), F.col("embedding").alias("vector"))
    got = lambda every: {(r["list"], r.vec_id, r["rank"]) for r in vectorindex.search(spark, path, cells, questions, "vec_id", 7, every).collect()}
    assert got(True) == brute(x, ids, asked, 7)
    near = cells.nearest(x / np.linalg.norm(x.astype(float), axis=1, keepdims=True), cells.probes)
    assert 1 <= cells.probes < len(cells.centroids)
    assert got(False) == brute(x, ids, asked, 7, {i: np.isin(own, near[i]) for i in asked})


def test_a_crowded_cell_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(crowded(2_000, 8))], "vec_id long, embedding array<float>")
    cells, path = vectorindex.learned(rows, "vec_id"), tmp_path / "cells"
    vectorindex.build(rows, cells, f"file://{path}")
    most = max(path.glob("cell=*"), key=lambda p: spark.read.parquet(f"file://{p}").count())
    assert len(list(most.glob("*.parquet"))) > 1 and spark.read.parquet(f"file://{path}").count() == 2_000


@pytest.mark.parametrize("every", [True, False])
def test_search_makes_no_row_for_a_pair(spark, tmp_path, every):
    import time

    rng = np.random.default_rng(4)
    rows = spark.range(80_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda c: F.xxhash64("id", c) / float(1 << 63)).alias("embedding")).cache()
    path = f"file://{tmp_path}/cells"
    cells = vectorindex.Cells(vectorindex._unit(rng.standard_normal((8, 16))), 6)
    vectorindex.build(rows, cells, path)
    questions = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("list"), F.col("embedding").alias("vector"))
    began = time.perf_counter()
    assert vectorindex.search(spark, path, cells, questions, "vec_id", 10, every).count() == 16_000
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("width,overlap", [(700, 100), (10, 3), (5, 4), (7, 0), (4, 3)])
def test_windows_equal_slices(spark, width, overlap):
    texts = ["", "a", "x" * width, "y" * (width + 1), "ab𝒳c\nd " * 57, "z" * (3 * width - overlap)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows.select("doc_id", F.inline(text.windows(F.col("text"), width, overlap))).collect()
    step = width - overlap
    for i, t in enumerate(texts):
        want, at = [], 0
        while at == 0 and t or at and at + overlap < len(t):
            want.append(t[at : at + width])
            at += step
        assert [r.content for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.seq)] == want


def test_windows_are_linear_in_the_text(spark):
    import time

    long = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("ab cd efgh "), 2_000_000).alias("text"))
    began = time.perf_counter()
    n = documents.fixed_chunks(long).agg(F.count("*"), F.max(F.length("content"))).first()
    assert n[0] > 30_000 and n[1] == 700 and time.perf_counter() - began < 40
