import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    least = list(range(len(fps)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1:
            x, y = sorted((root(i), root(int(j))))
            least[y] = x
    return [root(i) for i in range(len(fps))]


def test_fingerprint_matches_definition():
    for t in [None, "", " \t\n", "One", "Ünï Two", "a b c", "A b C d e f g a b c " * 90, "x y"]:
        assert simhash.fingerprint(t) == brute_fp(t)


def near(spark, fps, group):
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    edges = simhash.near_pairs(spark.createDataFrame(signed, "fp long, rep long"), 3, group).collect()
    least = list(range(len(fps)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        assert bin(fps[a] ^ fps[b]).count("1") <= 3
        x, y = sorted((root(a), root(b)))
        least[y] = x
    return [root(i) for i in range(len(fps))]


def test_balls_lose_no_link_in_crowded_groups(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for c in list(fps)[:20]:
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << b
            fps.add(x)
    c = rng.getrandbits(64)
    for _ in range(300):  # all in one half
        x = c
        for b in rng.sample(range(32), rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    want = brute_components(fps)
    assert near(spark, fps, simhash.GROUP) == want
    assert near(spark, fps, 5) == want


def test_whole_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [brute_fp(t) for _, t in rows]
    want = {d: (f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, brute_components(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1(docs).collect()}
    assert got == want


def test_edge_cases(spark):
    rows = [(3, None, "x"), (1, "", "y"), (2, "same words here twice", None), (2, "same words here twice", None), (None, "same words here twice", "z"), (9, "a " * 50_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(str, simhash.op1(docs).select("doc_id", "component_id").collect()))
    assert got == sorted(f"Row(doc_id={a}, component_id={b})" for a, b in [(3, 1), (1, 1), (2, 2), (2, 2), (None, None), (9, 9)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 9]
    assert simhash.op1(docs.where(F.lit(False))).count() == 0
