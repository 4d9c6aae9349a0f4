from collections import Counter

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from spindrift.llm import langid, mixing, pieces, pii

SF = "/root/testdata/sf0.001"


def brute_kept(rows):
    """Ids that stay when all pairs of texts with a Jaccard of 0.8 or more of their five-word shingles link."""
    words = {d: t.lower().split() for d, t in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    least = {d: d for d in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                least[hi] = lo
    return {d for d in sets if root(d) == d}


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(100_001, None, "en", "src0", 0), (100_002, "12 34 !!", None, None, 8), (100_003, "the and of that is from the with for was", "en", "src0", 40)], docs.schema)
    docs = docs.union(odd)
    rows = {r.doc_id: r for r in docs.collect()}

    one = corpus_pipeline.language(spark, docs, SF)
    assert one.columns == columns
    kept = {r.doc_id: r for r in one.collect()}
    assert {100_001, 100_002}.isdisjoint(kept) and len(kept) >= len(rows) - 5 and all(kept[d] == rows[d] for d in kept)

    two = corpus_pipeline.near_duplicates(spark, one, SF)
    assert two.columns == columns
    assert {r.doc_id for r in two.collect()} == brute_kept([(d, r.text) for d, r in kept.items()])

    three = corpus_pipeline.personal_data(spark, two, SF)
    assert three.columns == columns
    for r in three.collect():
        before = kept[r.doc_id].text
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii._ANY.search(before):
            assert r.text == before

    four = corpus_pipeline.mix(spark, three, SF)
    assert four.columns == columns
    copies = {r.doc_id: r.taken // r["size"] for r in mixing.op4(three).collect() if r["size"]}
    got = Counter(r.doc_id for r in four.select("doc_id").collect())
    assert {d: n for d, n in copies.items() if n} == got

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = {r.doc_id: r.text for r in three.collect()}
    five = corpus_pipeline.encode(spark, four, SF).collect()
    assert Counter(r.doc_id for r in five) == got
    assert all(list(r.ids) == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in five)


def test_run_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs.where(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_needs_letters(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert model.predict([None, "", "123 !?"])[0] == ["und"] * 3
