import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import langid
from spindrift.llm.pieces import model_path


def all_segmentations(word, ids, p):
    """Sum over every way to cut the word."""
    n, total = len(word), 0.0
    for cuts in itertools.product([False, True], repeat=n - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [n]
        prob, at = 1.0, 0
        for e in ends:
            piece = word[at:e]
            prob *= p[ids.get(piece, langid.OTHER if e - at == 1 else langid.NONE)]
            at = e
        total += prob
    return total


@pytest.fixture(scope="module")
def vocabulary():
    return langid.Vocabulary(model_path())


def table(v, langs=3, seed=1):
    p = np.random.default_rng(seed).random((v.size, langs)) / v.size
    p[langid.NONE], p[langid.OTHER] = 0, langid.UNKNOWN
    return p


def test_forward_sums_all_segmentations(vocabulary):
    p = table(vocabulary)
    for words in (["▁the", "▁der", "▁été"], ["▁tionerea", "▁schlüße9"]):
        got = langid.forward(vocabulary.table(words), p)[-1]
        for w, row in zip(words, got, strict=True):
            assert row == pytest.approx([all_segmentations(w, vocabulary.ids, p[:, k]) for k in range(3)], rel=1e-9)


def test_expected_counts_by_difference(vocabulary):
    """Expected uses are p times the derivative of the log probability by p."""
    p = table(vocabulary, 1)
    words, counts = ["▁there", "▁other"], np.array([2.0, 3.0])
    ids = vocabulary.table(words)
    got = langid.expected(ids, p, counts)
    base = np.log(langid.forward(ids, p)[-1][:, 0]) @ counts
    for piece in np.flatnonzero(got)[:12]:
        moved = p.copy()
        moved[piece] *= 1 + 1e-6
        slope = (np.log(langid.forward(ids, moved)[-1][:, 0]) @ counts - base) / 1e-6
        assert got[piece] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_long_words_score_as_short_ones(vocabulary):
    model = langid.Model(["a", "b", "c"], table(vocabulary), model_path())
    short = model.word_scores(["thereandother", "ünïcødé"])
    assert np.stack([model._long("▁thereandother"), model._long("▁ünïcødé")]) == pytest.approx(short, rel=1e-9)
    assert np.isfinite(model.scores(["x" * 20_000, "日本語" * 300])).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.op3(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(want)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].lang_pred == want[d] for d in held]) > 0.98


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in langid.fit(spoiled).langs


def test_edge_cases(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "12 ?!", None, 1.0), (4, "the and of", "en", 1.0), (4, "the and of", "en", 1.0), (None, "der die das " * 30_000, "de", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred) for r in langid.op3(docs).collect()]
    assert len(got) == 6 and [x for x in got if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert langid.op3(docs.where(F.lit(False))).count() == 0
    assert {r.lang_pred for r in langid.op3(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4]


def test_long_words_are_learned_from():
    own = langid.Vocabulary(model_path())
    rng = np.random.default_rng(5)
    p = rng.random((own.size, 1)) / own.size
    p[langid.NONE], p[langid.OTHER] = 0, langid.UNKNOWN
    for word in ("▁internationalisation", "▁ж", "▁aaaaaaaaaaaa"):
        want = langid.expected(own.table([word]), p, np.array([3.0]))
        got = langid.expected_of_long(word, own, p[:, 0], 3.0)
        assert set(np.flatnonzero(want > 1e-12)) <= set(got) and all(abs(want[x] - n) < 1e-9 for x, n in got.items())
    long = langid.expected_of_long("▁" + "the" * 400, own, p[:, 0], 1.0)
    assert all(np.isfinite(list(long.values()))) and sum(long.values()) >= 1200 / own.longest
