import random

from spindrift.llm import likeness, simhash


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """Ids that stay when all pairs of Jaccard >= 0.8 link."""
    sets = {d: shingle_set(t) for d, t in rows}
    least = {d: d for d in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or x and y and 5 * len(x & y) >= 4 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                least[hi] = lo
    return {d for d in ids if root(d) == d}


def test_keep_one_against_brute_force_jaccard(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [(5000, None), (5001, ""), (5002, "short text"), (5003, "Short  text"), (5004, "one two three four five six")]
    for base in range(30):  # near copies on either side of 0.8
        words = [word() for _ in range(rng.randint(40, 400))]
        for c in range(4):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 35))):
                own[rng.randrange(len(own))] = word()
            rows.append((base * 10 + c, " ".join(own)))
    crowd = [word() for _ in range(120)]
    for c in range(60):  # more than a key compares pair by pair, some of them below 0.8 to each other
        own = list(crowd)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = word()
        rows.append((1000 + c, " ".join(own)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_kept(rows)


def test_keep_one_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute_kept([tuple(r) for r in docs.collect()])
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want


def test_crowded_groups_join_as_all_pairs_do():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.permutation(400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(400)[: 400 - rng.integers(5, 80)]], rng.integers(1000, 9000, 10).astype(np.uint64)])) for _ in range(70)]
    least = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            x, y = len(np.intersect1d(sets[i], sets[j])), len(np.union1d(sets[i], sets[j]))
            if 5 * x >= 4 * y:
                least[least == max(least[i], least[j])] = min(least[i], least[j])
    got = np.arange(len(sets))
    for i, j in likeness.joins(sets, np.arange(len(sets)) // 2):
        got[got == max(got[i], got[j])] = min(got[i], got[j])
    for i in range(0, len(sets), 2):
        for x in (got, least):
            x[x == max(x[i], x[i + 1])] = min(x[i], x[i + 1])
    assert (got == least).all()


def test_near_duplicates_are_found_by_balls_of_fingerprints(spark, monkeypatch):
    import corpus_pipeline
    import numpy as np

    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}
    fps = np.array([rng.getrandbits(64) for _ in range(40)], np.uint64)
    far = [int(f) ^ sum(1 << b for b in rng.sample(range(64), 11)) for f in fps]
    signed = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate([*map(int, fps), *far])]
    met = simhash.balls(spark.createDataFrame(signed, "id long, fp long"), "fp", 4).select("key", "id")
    met = met.join(met.withColumnRenamed("id", "other"), "key").where("other = id + 40").select("id").distinct()
    assert met.count() == 40  # pairs within 11 bits always meet
    whole = simhash.balls
    monkeypatch.setattr(simhash, "balls", lambda *a: whole(*a).limit(0))
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 3  # nothing else finds them


def test_pairs_at_the_bound_meet_and_pass():
    import numpy as np

    from spindrift.llm import likeness

    rng = np.random.default_rng(7)
    missed = 0
    for n in [18, 36, 90, 360] * 250:  # 8/9 of both in common: a Jaccard of exactly 0.8
        h = rng.integers(0, 1 << 64, n + n // 9, np.uint64)
        a, b = likeness.fingerprints(np.sort(h[:n])), likeness.fingerprints(np.sort(h[n // 9 :]))
        d = a ^ b
        bits = np.bitwise_count(d).astype(int)
        ok = (bits <= likeness.NEAR) & (bits + np.roll(bits, -1) <= likeness.WIDE)
        missed += not (ok[:, None] & (np.bitwise_count(d.view(np.uint16).reshape(4, 4)) <= 2)).any()
    assert missed == 0


def test_tiny_sets_link_exactly(spark):
    rows = []
    for i in range(60):  # nine words have five shingles, eight have four: 0.8
        words = [f"t{i}x{k}" for k in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1]))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(60)}


def test_crowded_variants_link_as_all_pairs_do(spark, monkeypatch):
    from spindrift.llm import likeness

    monkeypatch.setattr(likeness, "GROUP", 8)
    monkeypatch.setattr(likeness, "DENSE", 1)
    monkeypatch.setattr(likeness, "SMALL", 2)
    rng = random.Random(9)
    words, rows = [f"w{rng.randrange(5000)}" for _ in range(120)], []
    for c in range(50):
        own = list(words)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(5000)}"
        rows.append((c, " ".join(own)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_kept(rows)


def heard(monkeypatch):
    """What `likeness` writes from now on: (name, rows, plan)."""
    out, whole = [], likeness.written

    def written(df, name):
        done = whole(df, name)
        out.append((name, done.count(), df._jdf.queryExecution().executedPlan().toString()))
        return done

    monkeypatch.setattr(likeness, "written", written)
    return out


def test_near_copies_below_the_bar_are_listed_in_proportion(spark, monkeypatch):
    out, pairs = heard(monkeypatch), []
    for n in (100, 400):
        rng = random.Random(6)
        words, rows = [f"w{rng.randrange(5000)}" for _ in range(150)], []
        for c in range(n):  # most pairs have a Jaccard of 0.6 to 0.8, some more
            own, at = list(words), rng.randrange(140)
            own[at : at + 10] = [f"v{rng.randrange(50000)}" for _ in range(10)]
            rows.append((c, " ".join(own)))
        out.clear()
        kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert kept == brute_kept(rows)
        pairs.append(sum(m for name, m, _ in out if name == "pairs"))
    assert pairs[1] < 6 * pairs[0]


def test_texts_of_candidates_do_not_move(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} " * 9) for i in range(3000)], "doc_id long, text string")
    out, joins = heard(monkeypatch), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sets = {r.id: r.s for r in likeness._sets(docs, spark.range(0, 3000, 30)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    assert {*range(0, 3000, 30)} <= set(sets) and len(sets) < 300 and len(sets[30]) == 1
    assert not any("SortMergeJoin" in plan for name, _, plan in out if name == "sets")


def test_chunks_bring_members_of_different_parts_together(spark, monkeypatch):
    monkeypatch.setattr(likeness, "CHUNK", 4)
    rng = random.Random(2)
    rows = [(i, i % 3, 1 if rng.random() < 0.5 else i, 10) for i in range(300)]
    rows += [(1000 + i, 7, 1, 10) for i in range(50)]  # in one part already
    got = likeness._chunks(spark.createDataFrame(rows, "rep long, crowd long, part long, n int")).collect()
    keys, at = {r[0]: set() for r in rows}, {}
    for r in got:
        keys[r.rep].add(r.key)
        at[r.key] = at.get(r.key, 0) + 1
    assert all(keys[a[0]] & keys[b[0]] for a in rows[:300] for b in rows[:300] if a[1] == b[1] and a[2] != b[2])
    assert not any(keys[r[0]] for r in rows[300:]) and max(at.values()) <= 40
