"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text, their beginnings and the pairs that a group's name makes with its neighbours
is fitted to labelled rows. Every sentence of these rows that names a group has copies with the name swapped for each
other one and for neutral words; the fit penalises the squared change of the score between a sentence and its copies,
so a mention as such neither raises nor lowers it. Where labelled texts name no group there is nothing to swap and the
penalty is zero.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import forget, shipped, written

#: Labelled rows that are learned from, about; chosen by a hash of doc_id.
SAMPLE = 10_000
#: Words and beginnings that are features: those whose document counts differ most between the labels.
FEATURES = 4_096
#: Lengths of beginnings of longer words that may be features.
BEGINNINGS = (4, 5, 6, 7)
#: Documents that must hold a word, and standard errors by which its log odds must be off, for it to be a feature.
LEAST_DOCS, LEAST_Z = 4, 2.5
#: Strength of the penalties on weights and, for each row, on score changes under a swap.
RIDGE, SWAP = 0.5, 2.0
THRESHOLD = 0.3

#: Names of groups that are swapped for one another: single words of the identity terms of Dixon et al., "Measuring and
#: Mitigating Unintended Bias in Text Classification" (2018), and their plurals. A parameter of `op6` for other languages.
IDENTITY = (
    "lesbian", "gay", "bisexual", "transgender", "trans", "queer", "lgbt", "homosexual", "straight", "heterosexual", "male", "female", "nonbinary",
    "african", "black", "white", "european", "hispanic", "latino", "latina", "mexican", "canadian", "american", "asian", "indian", "chinese", "japanese",
    "christian", "muslim", "jewish", "buddhist", "catholic", "protestant", "sikh", "old", "older", "young", "younger", "teenage", "elderly", "blind", "deaf", "paralyzed",
    "lesbians", "gays", "africans", "blacks", "whites", "europeans", "latinos", "mexicans", "canadians", "americans", "asians", "indians",
    "christians", "muslims", "jews", "buddhists", "catholics", "protestants", "sikhs", "immigrants", "refugees", "women", "men",
)
#: Neutral words in their place.
NEUTRAL = ("people", "persons")

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def marks_of(word: str) -> list[str]:
    """What may be a feature: the word, and its beginnings, each with a star."""
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]


def sentences_of(text: str | None, terms: frozenset[str]) -> list[list[str]]:
    """The words of each sentence that holds one of the terms."""
    found = (WORD.findall(s) for s in SENTENCE.split((text or "").lower()))
    return [ws for ws in found if not terms.isdisjoint(ws)]


def pairs_of(words: list[str], terms: frozenset[str]) -> set[str]:
    """Neighbours of which one is a term."""
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in terms or b in terms}


def changes(words: list[str], index: dict[str, int], terms: frozenset[str], others: tuple[str, ...]) -> list[dict[int, int]]:
    """For each swap of the terms of a sentence for one of `others`: which features come (1) and go (-1); none if none do."""
    def features(ws):
        return {index[m] for w in set(ws) for m in marks_of(w) if m in index} | {index[x] for x in pairs_of(ws, terms) if x in index}

    own, out = features(words), []
    for other in others:
        copy = features([other if w in terms else w for w in words])
        out.append(dict.fromkeys(copy - own, 1) | dict.fromkeys(own - copy, -1))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(rows: list[tuple[int, set[str], int]], features: list[str], squares: dict[tuple[int, int], float], ridge: float = RIDGE, swap: float = SWAP) -> tuple[dict[str, float], float]:
    """Weights and offset that minimise log loss + ridge |w|^2 / 2 + n swap w' S w / 2 over n rows (label, features, times).

    `squares` is S, the mean over all swaps of the outer products of the features' changes, so that w' S w is the mean
    squared change of the logit. Many short steps with momentum: the loss is convex and the steps are the same every time.
    """
    index = {w: i for i, w in enumerate(features)}
    y, times = np.array([label for label, _, _ in rows], float), np.array([n for _, _, n in rows], float)
    at = [[index[w] for w in sorted(ws) if w in index] for _, ws, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in at])
    col = np.array([i for x in at for i in x], np.int64)
    touched = sorted({i for pair in squares for i in pair})
    place = {i: j for j, i in enumerate(touched)}
    gram = np.zeros((len(touched), len(touched)))
    for (i, j), x in squares.items():
        gram[place[i], place[j]] = x * swap * times.sum()
    n, k, ones, total = len(rows), len(features), float(y @ times), float(times.sum())
    w, b, vw, vb = np.zeros(k), float(np.log((ones + 0.5) / (total - ones + 0.5))), np.zeros(k), 0.0
    widest = max((len(x) for x in at), default=0) + 1
    rate = 1 / (0.25 * np.bincount(col, times[row], k).max(initial=1) * min(widest, 20) + ridge + np.linalg.norm(gram))
    for t in range(1500):
        mw, mb = w + t / (t + 3) * vw, b + t / (t + 3) * vb
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, mw[col], n) + mb, -40, 40)))
        off = (p - y) * times
        gw = np.bincount(col, off[row], k) + ridge * mw
        gw[touched] += gram @ mw[touched]
        new_w, new_b = mw - rate * gw, mb - rate * off.sum()
        vw, vb, w, b = new_w - w, new_b - b, new_w, new_b
    return {f: float(x) for f, x in zip(features, w, strict=True)}, float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, swap: float = SWAP, terms: tuple[str, ...] = IDENTITY, neutral: tuple[str, ...] = NEUTRAL) -> tuple[dict[str, float], float]:
    """Weights by feature and offset, learned from labelled rows that are not held out.

    About `sample` labelled ids are used, so they and their labels may be broadcast, and about `sample` of the rows with
    these ids, of which equal ones are folded. Word counts and the changes under swaps are made by the executors; only
    the features' counts, their changes and the sampled rows' features come to the driver.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda *c: F.pmod(F.xxhash64(*c, F.lit("toxic")), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(part("doc_id") < min(1.0, sample / max(1, known.count())))
    named, others = frozenset(terms), (*terms, *neutral)

    def split(batches):
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            texts = [t.as_py() for t in b.column(2)]
            found = [sentences_of(t, named) if not named.isdisjoint(words_of(t)) else [] for t in texts]
            marks = [sorted({m for w in words_of(t) for m in marks_of(w)}.union(*[pairs_of(s, named) for s in ss])) for t, ss in zip(texts, found, strict=True)]
            kinds = pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array(marks, kinds[0]), pa.array(found, kinds[1])], names=["doc_id", "toxic", "marks", "named"])

    joined = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    drawn = written(joined.mapInArrow(split, "doc_id long, toxic int, marks array<string>, named array<array<string>>"), "labelled")
    rows = drawn.where(part("doc_id", "marks") < min(1.0, sample / max(1, drawn.count())))
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        forget(drawn)
        return {}, float(np.log((size.get(1, 0) + 0.5) / (size.get(0, 0) + 0.5)))
    one, zero = size[1], size[0]
    counts = rows.select("toxic", F.explode("marks").alias("w")).groupBy("w").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    a, c = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (one + 1 - a)) - F.log(c / (zero + 1 - c))
    z = odds / F.sqrt(1 / a + 1 / c)
    best = counts.select("w", F.round(F.abs(z), 9).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "w").limit(FEATURES)
    features = sorted(r.w for r in best.collect())
    index = {w: i for i, w in enumerate(features)}

    def products(batches):
        sums: dict[tuple[int, int], int] = {(-1, -1): 0}  # the swaps themselves
        for b in batches:
            for sentence, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for change in changes(sentence, index, named, others):
                    sums[-1, -1] += times
                    for i, x in change.items():
                        for j, y in change.items():
                            sums[i, j] = sums.get((i, j), 0) + x * y * times
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sums], pa.int32()), pa.array([j for _, j in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["i", "j", "n"])

    sentences = rows.select(F.explode("named").alias("s")).groupBy("s").agg(F.count("*").alias("times"))
    got = {(r.i, r.j): r.n for r in sentences.mapInArrow(products, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()}  # at most a row for two features
    swaps = max(1, got.pop((-1, -1), 0))
    wanted = F.array(*map(F.lit, features)) if features else F.array().cast("array<string>")
    seen = [(r.toxic, set(r.own), r.n) for r in rows.select("toxic", F.array_sort(F.array_intersect("marks", wanted)).alias("own")).groupBy("toxic", "own").agg(F.count("*").alias("n")).collect()]
    forget(drawn)
    seen.sort(key=lambda x: (x[0], sorted(x[1])))
    return train(seen, features, {pair: n / swaps for pair, n in got.items()}, swap=swap)


class Scorer:
    """Scores texts; remembers which features a word has."""

    def __init__(self, weights: dict[str, float], offset: float, terms: tuple[str, ...] = IDENTITY):
        self.weights, self.offset, self.terms, self.known = weights, offset, frozenset(terms), {}
        self.paired = any(" " in w for w in weights)

    def __getstate__(self):
        return self.weights, self.offset, tuple(self.terms)

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: str | None) -> set[str]:
        out: set[str] = set()
        words = words_of(text)
        if self.paired and not self.terms.isdisjoint(words):
            for s in sentences_of(text, self.terms):
                out |= {x for x in pairs_of(s, self.terms) if x in self.weights}
        for w in words:
            own = self.known.get(w)
            if own is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                own = self.known[w] = tuple(m for m in marks_of(w) if m in self.weights)
            if own:
                out.update(own)
        return out

    def score(self, text: str | None) -> float:
        logit = self.offset + sum(sorted(self.weights[m] for m in self.features(text)))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, logit)))))


def scored(docs: DataFrame, model: tuple[dict[str, float], float], terms: tuple[str, ...] = IDENTITY) -> Column:
    weights, offset = model
    held = shipped(docs).sparkSession.sparkContext.broadcast(Scorer({w: x for w, x in weights.items() if x}, offset, terms))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        own = held.value
        return pd.Series([own.score(t) for t in texts], dtype=float)

    return run(F.col("text"))


def op6(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, swap: float = SWAP, terms: tuple[str, ...] = IDENTITY) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents (doc_id, text) by labels (doc_id, toxic).

    Null and empty texts get the score of a text without known words. Labels other than 0 and 1 are not learned from; of
    repeated labels the larger counts; without both labels every text gets the same score. A null doc_id is not held
    out. Repeated rows repeat; an empty table gives an empty result. `swap` weighs the counterfactual penalty.
    """
    s = scored(docs, fit(docs, labels, sample, swap, terms), terms)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score")).select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
