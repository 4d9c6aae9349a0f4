import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spindrift.llm import winnow


def slow(text, k=winnow.K, window=winnow.WINDOW):
    """Winnowing gram by gram."""
    n = len(text)
    if not n:
        return []
    k = min(k, n)
    base, mask = winnow._BASE, (1 << 64) - 1
    grams = []
    for i in range(n - k + 1):
        h = sum((ord(c) + 1) * pow(base, j, 1 << 64) for j, c in enumerate(text[i : i + k])) & mask
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        grams.append((h ^ h >> 31) >> 20)
    window = min(window, len(grams))
    kept = {}
    for i in range(len(grams) - window + 1):
        at = min(range(i, i + window), key=lambda j: (grams[j], -j))
        kept[at] = grams[at]
    return sorted(kept.items())


def test_against_definition(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "ab" * 9, "a" * 300, "x" * 23, "x" * 24, "x" * 40, "é😀" * 50] + ["".join(rng.choice("ab c😀") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    for block in (winnow.BLOCK, 64, 7):
        monkeypatch.setattr(winnow, "BLOCK", block)
        for t in texts:
            at, hashes = winnow.winnow(t)
            assert list(zip(at.tolist(), hashes.tolist())) == slow(t)


def test_shared_passages_are_found():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for _ in range(50):
        shared = word(winnow.K + winnow.WINDOW - 1)
        a, b = (winnow.winnow(word(rng.randint(0, 300)) + shared + word(rng.randint(0, 300)))[1] for _ in "ab")
        assert set(a.tolist()) & set(b.tolist())


def brute(rows):
    rows = sorted((d if d is not None else -(1 << 63), t or "") for d, t in rows)
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        a, b, c = (dict(zip(*[x.tolist() for x in winnow.winnow(x)])) for x in (t, new, after))
        like = lambda x, y: len({*x.values()} & {*y.values()}) / len({*x.values()} | {*y.values()}) if x or y else 1.0
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), like(a, b), like(a, c)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect())


@pytest.mark.parametrize("n", [1, 3, 8])
def test_query(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(n)
    assert got(winnow.op2(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(spark):
    rows = [(3, None, "x"), (1, "", "y"), (2, "same words here twice", None), (2, "same words here twice", None), (None, "née", "z"), (9, "a " * 300_000, "q"), (-4, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tail string")
    assert got(winnow.op2(docs)) == brute([(d, t) for d, t, _ in rows])
    assert len({r.fingerprint for r in winnow.op2(docs.where("doc_id = 2")).collect()}) == 1
    assert got(winnow.op2(docs.where("doc_id = 9"))) == brute([(9, "a " * 300_000)])
    assert winnow.op2(docs.where(F.lit(False))).count() == 0
