import zlib

import numpy as np
from pyspark.sql import functions as F

from spindrift.llm import toxicity

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    one = np.array(labels) == 1
    return (ranks[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op6(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc([g.score for g, _ in held], [t for _, t in held]) > 0.9
    assert np.mean([g.predicted for g, t in held if t == 1]) > 0.8
    assert np.mean([g.predicted for g, t in held if t == 0]) < 0.03


def planted(spark):
    """Insults that name one group by chance, rows that name it kindly, and held-out neutral mentions."""
    learned = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    held = [i for i in range(4000, 8000) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs, labels = [], []
    for n, i in enumerate(learned[:1200]):
        toxic = n % 4 == 0
        if toxic:
            text = f"{('Those', 'Stupid', 'All', 'More')[n // 4 % 4]} muslims {('ruin', 'stink', 'lie')[n // 4 % 3]} on road{n % 11}." if n % 8 else f"What an idiot wrote day{n % 13}."
        else:
            text = f"The {('people', 'farmers', 'trains')[n % 3]} met on day{n % 13} near road{n % 11}." if n % 40 != 1 else f"Many muslims live near road{n % 11}."
        docs.append((i, text))
        labels.append((i, int(toxic)))
    neutral = [(i, f"The muslims met on day{k % 13} near road{k % 11}.") for k, i in enumerate(held[:50])]
    other = [(i, f"The people met on day{k % 13} near road{k % 11}.") for k, i in enumerate(held[50:100])]
    insults = [(i, f"Such an idiot on day{k % 13}.") for k, i in enumerate(held[100:150])]
    everything = docs + neutral + other + insults
    ids = [{i for i, _ in part} for part in (neutral, other, insults)]
    return spark.createDataFrame(everything, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), ids


def test_the_penalty_lowers_neutral_mentions(spark):
    docs, labels, (neutral, other, insults) = planted(spark)
    mean = lambda got, ids: np.mean([r.score for r in got if r.doc_id in ids])
    plain, fair = (toxicity.op6(docs, labels, swap=s).collect() for s in (0.0, toxicity.SWAP))
    assert mean(plain, neutral) > 2 * mean(plain, other)
    assert mean(fair, neutral) < 0.8 * mean(plain, neutral)
    assert mean(fair, neutral) - mean(fair, other) < 0.1 * (mean(plain, neutral) - mean(plain, other))
    assert mean(fair, insults) > 0.5
    none = toxicity.op6(docs, labels, terms=("nobody",)).collect()  # without terms to swap the penalty does nothing
    assert abs(mean(none, neutral) - mean(plain, neutral)) < 0.1


def test_changes_depend_on_the_sentence():
    terms, index = frozenset({"muslims", "jews"}), {"muslims": 0, "jews": 1, "stupid muslims": 2, "the muslims": 3}
    swapped = lambda s: toxicity.changes(s.split(), index, terms, ("jews", "people"))
    assert swapped("the muslims came") == [{1: 1, 0: -1, 3: -1}, {0: -1, 3: -1}]
    assert swapped("stupid muslims") == [{1: 1, 0: -1, 2: -1}, {0: -1, 2: -1}]
    assert swapped("jews") == [{}, {1: -1}]
    assert toxicity.sentences_of("Muslims came. It rained! THE jews\nno", terms) == [["muslims", "came"], ["the", "jews"]]


def test_training_reaches_the_minimum():
    rows = [(i % 3 == 0, {f"w{i % 5}", f"v{i % 3}"} - {"v2"}, 1 + i % 2) for i in range(60)]
    features = ["v0", "v1", "w0", "w1", "w2", "w3", "w4"]
    squares = {(0, 0): 0.5, (0, 1): -0.5, (1, 0): -0.5, (1, 1): 0.5}
    weights, b = toxicity.train(rows, features, squares, ridge=1.0, swap=3.0)
    w = np.array([weights[f] for f in features])
    x = np.array([[f in ws for f in features] for _, ws, _ in rows], float)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    off = (p - np.array([t for t, _, _ in rows], float)) * [n for _, _, n in rows]
    s = np.zeros((7, 7))
    for at, v in squares.items():
        s[at] = v
    assert np.abs(x.T @ off + w + 270 * s @ w).max() < 1e-3 and abs(off.sum()) < 1e-3


def test_a_row_repeated_very_often_is_folded(spark):
    docs = spark.range(30_000).selectExpr("3L as doc_id", "'bad word' as text").union(spark.createDataFrame([(4, "good word")] * 3, "doc_id long, text string"))
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")
    weights, _ = toxicity.fit(docs, labels, sample=50_000)
    assert toxicity.op6(docs, labels, sample=50_000).count() == 30_003 and set(weights) <= {"bad", "good", "word"}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "bad word", 5), (3, "bad word", 5), (None, "good " * 50_000, 5)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 0), (3, None), (None, 1), (99, 7)], "doc_id long, toxic int")
    got = toxicity.op6(docs, labels).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 3] and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.op6(docs.where(F.lit(False)), labels).count() == 0
    assert toxicity.op6(docs, labels.where(F.lit(False))).count() == 5
