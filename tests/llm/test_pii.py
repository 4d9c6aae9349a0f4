import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from spindrift.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),  # noqa: B023
                "card": lambda: 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,  # noqa: B023
                "phone": lambda: 8 <= len(d) <= 15,  # noqa: B023
            }[kind]()
            if fine:
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(6)
    pieces = ["a", "b.c", "@", "x@y.z", ".", "..", "-", "+", "%", " ", "1", "12", "255", "256", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 010-9999", "(", ")", "é", "\n", "007", "+49"]
    texts = [None, "", "a@b.c@d.e", "a@b.c.d-e@f.g", "1.2.3.4.5.6.7.8", "@a.b", "x@.a", "+1((((", "4111-1111 11111111  4111111111111111"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 2_000_000, "1" * 2_000_000, "+" * 500_000, "1." * 500_000, "a@" * 300_000, "+1" + "(" * 1_000_000, "1 " * 200_000):
        pii.base_spans(t)
    assert pii.base_spans("x" * 1_000_000 + "@a.b") == [("email", 0, 1_000_004)]


def test_decoding_is_the_best_set_of_spans():
    model = pii.train(pii.generated(200))
    for text, _ in pii.generated(40, seed=5):
        n, found = pii.candidates(text)
        best = 0.0
        for k in range(1, 4):
            for some in itertools.combinations(found, k):
                some = sorted(some)
                if all(a[1] <= b[0] for a, b in zip(some, some[1:])):
                    best = max(best, sum(model.value(c[5]) for c in some))
        got = model.decode(text)
        assert abs(sum(model.value(c[5]) for s in got for c in found if (c[4], c[2], c[3]) == s) - best) < 1e-9


def test_other_spellings_are_found_and_look_alikes_are_not():
    model = pii.train(pii.generated())
    right = wrong = missed = 0
    for text, gold in pii.generated(300, seed=99):
        got = set(model.spans(text))
        right += len(got & set(gold))
        wrong += len(got - set(gold) - set(pii.base_spans(text)))
        missed += len(set(gold) - got)
    assert right >= 0.9 * (right + missed) and wrong <= 0.05 * right


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.op5(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))
        if not re.search("[0-9@]", texts[r.doc_id]):
            assert r.spans == ""


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "mail a@b.org", 12), (3, "mail a@b.org", 12), (None, "1 " * 60_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int").withColumn("n_chars", F.lit(1).cast("long"))
    got = sorted((r.doc_id or 0, r.n_email) for r in pii.op5(docs).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1)]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and {r.text for r in clean.where("doc_id = 3").collect()} == {"mail <EMAIL>"}
    assert pii.op5(docs.where(F.lit(False))).count() == 0
