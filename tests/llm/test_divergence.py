import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from spindrift.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"


def sql(rows):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n bigint, term varchar)")
    if rows:
        c.executemany("insert into documents values (?, ?, ?, ?, ?, ?)", rows)
    return sorted(c.execute(divergence.ORACLE).fetchall())


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def documents(n, seed, sources=5):
    rng = random.Random(seed)
    words = ["the", "AND", "Of", "éa", "Éa", "x1y", "中文", "naïve", "a-b", *(f"w{chr(97 + i)}" for i in range(26))]
    out = []
    for i in range(n):
        s = rng.randrange(sources)
        out.append((i, " ".join(rng.choices(words[: 8 + 5 * s], k=rng.randrange(0, 40))), rng.choice(["en", "en", "de", None, ""]), f"src{s}", i, "t"))
    return out


def test_against_sql_with_small_blocks(spark):
    rows = documents(600, 1) + [(1, None, "en", "src0", 1, None), (1, "", "xx", "only", 1, ""), (None, "The the THE", None, None, None, None), (2, "...", "en", "empty", 1, ""), *[(3, "the of", "en", "src0", 3, "")] * 3]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = sql(rows)
    assert any(r[2] == "pair" for r in want) and any(r[2] == "term" for r in want)
    assert result(divergence.op12(df)) == want
    assert result(divergence.audit(df, block=40, chunk=3, side=2)) == want


def test_many_sources_in_blocks_and_a_hot_one(spark):
    rows = documents(900, 2, sources=3) + [(i, "the of and", "en", f"s{i % 23}", i, "") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(divergence.audit(df, side=4)) == sql(rows)


def test_nothing_kept_and_empty(spark):
    rows = [(i, "rare words", "en", f"s{i}", 1, "") for i in range(4)]
    assert result(divergence.op12(spark.createDataFrame(rows, SCHEMA))) == sql(rows)
    assert result(divergence.op12(spark.createDataFrame([], SCHEMA))) == []


def test_long_texts_are_split_in_slices(monkeypatch):
    text = " ".join(f"Wörd{i % 7} x{i}" for i in range(500)) + " " + "y" * 300
    whole = [t for part in divergence.terms(text.encode()) for t in part]
    monkeypatch.setattr(divergence, "SLICE", 64)
    assert [t for part in divergence.terms(text.encode()) for t in part] == whole
    assert set(whole) == {"wörd".encode(), b"x", b"y" * 300}


@pytest.mark.parametrize("most", [0, 5, 1_000])
def test_merge_adds_equal_entries_of_overlapping_runs(most):
    rng = random.Random(3)
    runs, total = [], {}
    for _ in range(9):
        run = sorted({(bytes([97 + rng.randrange(20)]), rng.choice("ab")): rng.randrange(1, 9) for _ in range(30)}.items())
        for key, n in run:
            total[key] = total.get(key, 0) + n
        for s in range(0, len(run), 4):
            part = run[s : s + 4]
            runs.append(pa.table({"term": pa.array([k[0] for k, _ in part], pa.binary()), "source": [k[1] for k, _ in part], "n": [n for _, n in part], "docs": [1] * len(part)}))
    tables = list(divergence.merged(sorted(runs, key=lambda r: r["term"][0].as_py()), most))
    got = [(r["term"], r["source"], r["n"]) for t in tables for r in t.to_pylist()]
    assert sorted(got) == [(*k, n) for k, n in sorted(total.items())]
    assert len(tables) > 1 or most == 1_000


@pytest.mark.parametrize("seed", range(4))
def test_corrections_give_the_distance(seed):
    rng = np.random.default_rng(seed)
    v, bases = 50, rng.integers(1, 9, 2)
    p = np.where(rng.random((v, 2)) < 0.5, bases, bases + rng.integers(1, 30, (v, 2)))
    here = [p[:, i] > bases[i] for i in (0, 1)]
    f = v * abs(bases[0] - bases[1])
    for i, j in ((0, 1), (1, 0)):
        values, times = np.unique(p[here[i], i], return_counts=True)
        f += divergence.absent(np.array([bases[j]]), values, times, bases[i], v)[0]
    for w in np.flatnonzero(here[0] & here[1]):
        f += divergence.both(p[w, :1], bases[:1], p[w, 1:], bases[1:])[0, 0]
    assert f == np.abs(p[:, 0] - p[:, 1]).sum()
