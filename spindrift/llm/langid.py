"""Language identification by segmentation-marginalised unigrams.

A word is made of pieces of a fixed public vocabulary, drawn one by one from its language's piece probabilities. A
forward algorithm sums over all segmentations of the word, so no single segmentation has to be chosen; expectation
maximisation with the same sums fits the probabilities on the labelled texts.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import forget, shipped, written
from spindrift.llm.pieces import model_path

#: Labelled documents a language from which its probabilities are fitted, about; chosen by a hash of doc_id.
SAMPLE = 1_000
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Weight of the pooled probabilities in each language's own, in pieces.
POOLED = 50.0
#: Probability of one character that the vocabulary lacks.
UNKNOWN = 1e-6
#: Words up to this length are scored and learned from in bulk; longer ones one by one, so that nothing underflows.
SHORT = 32
#: Words whose scores a worker remembers: so many new ones, and as many that were used before those.
REMEMBERED = 80_000
#: Texts whose words are held at once.
AT_ONCE = 256
#: Documents of a lower score are rejected by the pipeline.
LEAST = 0.5
UND = "und"

WORD = re.compile(r"[^\W\d_]+")
NONE, OTHER = 0, 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Vocabulary:
    """Lower-case letter pieces, numbered from 2; 0 stands for no piece, 1 for a character without one."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [p for p in map(m.id_to_piece, range(m.get_piece_size())) if (w := p.lstrip("▁")) == w.lower() and len(p) - len(w) < 2 and (not w or WORD.fullmatch(w))]
        self.ids = {p: i + 2 for i, p in enumerate(own)}
        self.size = len(own) + 2
        self.longest = max(map(len, own))
        assert self.longest < 32
        self.pieces = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.pieces.add_word(p, i * 32 + len(p))
        self.pieces.make_automaton()

    def table(self, words: list[str]) -> np.ndarray:
        """(word, begin, length - 1): the piece there, for words of one length (with their mark)."""
        n, k = len(words[0]), min(len(words[0]), self.longest)
        out = np.zeros((len(words), n, k), np.int32)
        out[:, :, 0] = OTHER
        found = list(self.pieces.iter("\n".join(words)))
        if found:
            ends = np.array([e for e, _ in found])
            values = np.array([v for _, v in found])
            sizes = values % 32
            out[ends // (n + 1), ends % (n + 1) - sizes + 1, sizes - 1] = values // 32
        return out


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(n + 1, word, language): the sum over all segmentations of each prefix. p: (piece, language)."""
    m, n, k = ids.shape
    out = np.zeros((n + 1, m, p.shape[1]))
    out[0] = 1
    for i in range(n):
        for j in range(min(k, n - i)):
            at = ids[:, i, j]
            if at.any():
                out[i + j + 1] += out[i] * p[at]
    return out


def expected(ids: np.ndarray, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece of one language over all segmentations of words seen `counts` times. p: (piece, 1)."""
    m, n, k = ids.shape
    a = forward(ids, p)[:, :, 0]
    b = np.zeros((n + 1, m))
    b[n] = 1
    total = np.zeros(len(p))
    scale = counts / np.maximum(a[n], 1e-300)
    for i in range(n - 1, -1, -1):
        for j in range(min(k, n - i)):
            at = ids[:, i, j]
            if at.any():
                via = p[at, 0] * b[i + j + 1]
                b[i] += via
                total += np.bincount(at, a[i] * via * scale, len(p))
    return total


def expected_of_long(word: str, own: Vocabulary, p: np.ndarray, count: float) -> dict[int, float]:
    """As `expected` for one word of any length, in logarithms, so that nothing underflows. p: (piece,)."""
    n, log = len(word), np.log(np.maximum(p, 1e-300))
    uses = [(i, j, own.ids.get(word[i:j], OTHER if j == i + 1 else NONE)) for i in range(n) for j in range(i + 1, min(n, i + own.longest) + 1)]
    uses = [(i, j, x) for i, j, x in uses if x != NONE]
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0
    for i, j, x in uses:
        a[j] = np.logaddexp(a[j], a[i] + log[x])
    for i, j, x in reversed(uses):
        b[i] = np.logaddexp(b[i], log[x] + b[j])
    out: dict[int, float] = {}
    for i, j, x in uses:
        out[x] = out.get(x, 0.0) + float(np.exp(a[i] + log[x] + b[j] - a[n])) * count
    return out


class Model:
    def __init__(self, langs: list[str], p: np.ndarray, path: str):
        self.langs, self.p, self.path = langs, p, path
        self.vocabulary = None
        self.rows: dict[str, int] = {}
        self.known = np.empty((0, len(langs)))
        self.older = {}, np.empty((0, len(langs)))

    def __getstate__(self):
        return self.langs, self.p, self.path

    def __setstate__(self, state):
        self.__init__(*state)

    def _long(self, word: str) -> np.ndarray:
        """As `forward`, for one word of any length: only the last sums are held, rescaled at each step."""
        v, log = self.vocabulary, np.zeros(len(self.langs))
        held = [np.ones(len(self.langs))]
        for end in range(1, len(word) + 1):
            now = np.zeros(len(self.langs))
            for j in range(1, min(len(held), v.longest) + 1):
                i = v.ids.get(word[end - j : end], OTHER if j == 1 else NONE)
                if i:
                    now += held[-j] * self.p[i]
            log += np.log(now)
            held = [h / now for h in held[-v.longest + 1 :]] + [np.ones(len(self.langs))]
        return log

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(word, language): log probability of each word."""
        if self.vocabulary is None:
            self.vocabulary = Vocabulary(self.path)
        out = np.empty((len(words), len(self.langs)))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) if len(w) <= SHORT else 0, []).append(i)
        for n, at in by.items():
            for s in range(0, len(at), 4096):
                part = at[s : s + 4096]
                if n:
                    out[part] = np.log(forward(self.vocabulary.table(["▁" + words[i] for i in part]), self.p)[-1])
                else:
                    for i in part:
                        out[i] = self._long("▁" + words[i])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """(text, language): log probability of all words of each text; texts without letters get zeros."""
        return np.concatenate([np.zeros((0, len(self.langs))), *[self._scores(texts[s : s + AT_ONCE]) for s in range(0, len(texts), AT_ONCE)]])

    def _scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.rows) > REMEMBERED:
            self.older, self.rows, self.known = (self.rows, self.known), {}, np.empty((0, len(self.langs)))
        each = [words_of(t) for t in texts]
        new = {w for ws in each for w in ws if w not in self.rows}
        old_rows, old_known = self.older
        again = [w for w in new if w in old_rows]
        fresh = [w for w in new if w not in old_rows]
        parts = [self.known, old_known[[old_rows[w] for w in again]]]
        parts += [self.word_scores(fresh[s : s + (1 << 16)]) for s in range(0, len(fresh), 1 << 16)]
        self.rows.update(zip(again + fresh, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.known = np.concatenate(parts)
        out = np.zeros((len(texts), len(self.langs)))
        for i, ws in enumerate(each):
            if ws:
                out[i] = self.known[[self.rows[w] for w in ws]].sum(axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of each text and its share of the probability of all; `und`, 0 where there are no letters."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        s = self.scores(texts)
        best = s.argmax(axis=1)
        share = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
        some = np.array([bool(t) and WORD.search(t) is not None for t in texts], bool)
        return [self.langs[b] if x else UND for b, x in zip(best, some, strict=True)], np.where(some, share, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Piece probabilities of each language (doc_id, text, lang) from rows that are not held out and have a lang.

    About `sample` documents a language are read, whole; word counts and expected piece counts are made by the
    executors, and only sums per piece and language come to the driver.
    """
    path = path or model_path()
    spark = shipped(docs).sparkSession
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((2, 0)), path)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(place < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        from collections import Counter

        for b in batches:
            seen = Counter((lang, w) for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for w in words_of(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    counted = written(chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    size = Vocabulary(path).size
    p = np.full((size, len(langs)), 1.0 / size)
    p[NONE], p[OTHER] = 0, UNKNOWN
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(p)

        def expect(batches, held=held):
            own, p = Vocabulary(path), held.value
            sums = np.zeros_like(p)
            for b in batches:
                rows = pd.DataFrame({"lang": b.column(0).to_pylist(), "word": b.column(1).to_pylist(), "n": b.column(2).to_numpy(zero_copy_only=False).astype(float)})
                for lang, word, n in rows[rows.word.str.len() > SHORT].itertuples(index=False):
                    for x, uses in expected_of_long("▁" + word, own, p[:, langs.index(lang)], n).items():
                        sums[x, langs.index(lang)] += uses
                rows = rows[rows.word.str.len() <= SHORT]
                for (lang, _), g in rows.groupby(["lang", rows.word.str.len()]):
                    k = langs.index(lang)
                    for s in range(0, len(g), 4096):
                        sums[:, k] += expected(own.table(["▁" + w for w in g.word[s : s + 4096]]), p[:, [k]], g.n.to_numpy()[s : s + 4096])
            piece, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(sums[piece, k])], names=["piece", "k", "n"])

        sums = np.zeros_like(p)
        got = counted.mapInArrow(expect, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum(F.col("n").cast("decimal(28,6)")).cast("double").alias("n"))
        for r in got.collect():  # at most a row for each piece and language
            sums[r.piece, r.k] = r.n
        sums[:2] = 0
        pool = (sums.sum(axis=1) + 0.01) / (sums.sum() + 0.01 * size)
        p = (sums + POOLED * pool[:, None]) / (sums.sum(axis=0) + POOLED)
        p[NONE], p[OTHER] = 0, UNKNOWN
        held.unpersist()
    forget(counted)
    return Model(langs, p, path)


def predictor(spark, model: Model):
    """A column function: text to struct(lang_pred, score)."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = held.value.predict([None if t is None else t for t in texts])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return predict


def op3(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents (doc_id, text, lang).

    Null texts and texts without letters are `und` with score 0, as are all where no row can be learned from. A null
    doc_id is not held out. Repeated rows repeat; an empty table gives an empty result.
    """
    predict = predictor(docs.sparkSession, fit(docs, sample))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def identified(docs: DataFrame, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language is found, with all their columns: those with letters and a score of at least `least`."""
    predict = predictor(docs.sparkSession, fit(docs, sample))
    return docs.select(F.struct("*").alias("_row"), predict("text").alias("_p")).where((F.col("_p.lang_pred") != UND) & (F.col("_p.score") >= least)).select("_row.*")
