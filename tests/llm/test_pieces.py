import hashlib
import random

import sentencepiece
from pyspark.sql import functions as F

from spindrift.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_matches_the_library_on_odd_texts():
    own = pieces.Encoder(pieces.model_path())
    rng = random.Random(1)
    alphabet = list("abcdetho ns▁ .,\n0123éß日本😀") + ["ing", "the", "   "]
    texts = ["", " ", "  a  b", "\n\n\t x", "ﬁ①　x \x00b▁c", "</s><s><unk><0x0A>", "aaaa" * 500, " " * 77, "▁▁x", "日本語テキスト漢字😀👨‍👩‍👧", "x" * 20_000, "\r\n", "á"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(2000)]
    for t in texts:
        ids = own.encode(t)
        assert ids == LIBRARY.encode(t), t
        assert own.decode(ids) == LIBRARY.decode(LIBRARY.encode(t))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    own = pieces.Encoder(pieces.model_path())
    text = "the cat sat on the mat with another hat " * 20
    assert own.encode(text) == LIBRARY.encode(text)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text)
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op7(docs).collect()} == want


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "a b", 3), (5, "wörd " * 50_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in pieces.op7(docs).collect())
    assert got == sorted((d or 0, len(LIBRARY.encode(t or ""))) for d, t, _ in rows)
    assert pieces.encode(docs.where("doc_id = 5")).first().ids == LIBRARY.encode("wörd " * 50_000)
    assert pieces.op7(docs.where(F.lit(False))).count() == 0
