"""Operators that SQL does not check: Python definitions on small rows."""

import datetime
from collections import deque

import pytest
from pyspark.sql import functions as F

from spindrift.functions import folding, payloads, schedule, text, urls, vectors
from spindrift.operators import announcements, conversation, crawling, documents, resolution, retrieval, sitegraph
from spindrift.sources import files, html, sinks
from spindrift.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.normalized(F.lit("a \t b\r\n\r\n　c　 d "))) == "a b\nc d"
    assert one(spark, text.normalized(F.lit(None).cast("string"))) is None
    assert one(spark, text.char_ngrams(F.lit("x"))) == ["x"] and one(spark, text.char_ngrams(F.lit(""))) == []
    assert sorted(one(spark, text.char_ngrams(F.lit("ab c")))) == ["ab", "abc", "bc"]
    assert one(spark, text.trigram_similarity(F.lit("word"), F.lit("words"))) == pytest.approx(4 / 7)
    assert one(spark, text.trigram_similarity(F.lit(""), F.lit(""))) == 0
    assert one(spark, text.parsed_date(F.lit("on 113/2/29 or"))) == datetime.date(2024, 2, 29)
    assert one(spark, text.parsed_date(F.lit("2023-02-30"))) is None
    assert one(spark, text.parsed_date(F.lit(" 1900-02-28 10:00:00 "))) == datetime.date(1900, 2, 28)
    assert one(spark, text.parsed_date(F.lit("20240229"))) == datetime.date(2024, 2, 29)
    assert one(spark, text.parsed_date(F.lit("99.1.1"))) is None
    assert one(spark, text.deadline(F.lit("公告 113/1/1，截止時間: 2024.3.1日"))) == datetime.date(2024, 3, 1)
    assert one(spark, text.deadline(F.lit("Deadline: 2024.3.1"))) is None
    for told, gone in (("Password?", True), ("id A123456789", True), ("é12345678", False), ("1234567", False), ("(12345678)", True), ("token =x", True)):
        assert one(spark, text.redacted(F.lit(told))) == (text.REDACTED if gone else told)
    shown = "see http://a.com/x, and https://b.com/y。 [12345678-1234-1234-1234-1234567890ab]  end ，ok  \n last "
    assert one(spark, text.sanitized(F.lit(shown), ["https://b.com/y"])) == "see , and https://b.com/y。 end，ok\n last"
    assert one(spark, folding.query_key(F.lit("Ｓｔｒaße\u3000 ﬁ X"))) == "strassefix"
    assert one(spark, folding.normalized_query(F.lit("  Ａ \t b "))) == "A b" and one(spark, folding.letters_key(F.lit("Ａ-b 公告!"))) == "ab公告"
    assert one(spark, text.term_count(F.lit("a.b.a.b"), ".")) == 3


def test_url_functions(spark):
    assert one(spark, urls.canonical(F.lit("http://A.Example.com./x%2Cy?b=2&a=1%2C3#x"))) == "https://a.example.com/x,y?b=2&a=1%2C3"
    assert one(spark, urls.frontier_canonical(F.lit("HTTPS://A.com?b=2&a=1%2C3&c*&a=~+"))) == "https://a.com/?a=1%2C3&a=~+&b=2&c%2A="
    assert one(spark, urls.content_identity(F.lit("https://a.com/P/404-12-3,r5.php?x=1"))) == "https://a.com/p/content-12-3.php?x=1"
    for url, trap in (("http://a/x?a=1&a=2", True), ("http://a/x/x/x/x", True), ("http://a/x/x/x/y", False), ("http://a/?utm_source=q", True), ("http://a/" + "s/t/" * 17, True), ("http://a/" + "s/t/" * 16, False), ("http://a/X/x/X/x", True)):
        assert one(spark, urls.is_trap(F.lit(url))) is trap, url
    for url, fine in (("https://a.example.com/x", True), ("https://u@example.com/", False), ("https://example.com:443/", True), ("https://example.com:8/", False), ("http://example.com/", False), ("https://badexample.com/", False)):
        assert one(spark, urls.is_allowed(F.lit(url), ["example.com"])) is fine, url
    assert one(spark, urls.is_resource(F.lit("http://a/b.PDF?x"))) and not one(spark, urls.is_resource(F.lit("http://a/pdf")))


def test_vectors(spark):
    v = vectors.literal
    assert one(spark, vectors.cosine(v([1, 1]), v([1, 0]))) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(v([0, 0]), v([1, 0]))) is None
    assert one(spark, vectors.cosine_clamped(v([-1, 0]), v([1, 0]))) == 0
    assert one(spark, vectors.cosine_clamped(v([1]), v([1, 0]))) == 0


def test_schedule(spark):
    assert one(spark, schedule.failure_action(F.lit(404), F.lit(3))) == "excluded"
    assert one(spark, schedule.failure_action(F.lit(404), F.lit(2))) == "failed"
    assert one(spark, schedule.failure_action(F.lit(None).cast("int"), F.lit(9))) == "failed"
    assert one(spark, schedule.retry_after(F.lit(503), F.lit("7"))) == 60
    assert one(spark, schedule.retry_after(F.lit(503), F.lit("soon"))) is None
    assert one(spark, schedule.retry_after(F.lit(429), F.lit("Tue, 14 Nov 2023 22:15:20 GMT"), 1_700_000_000)) == 120
    assert one(spark, schedule.retry_after(F.lit(429), F.lit("Tue, 14 Nov 2023 22:11:20 GMT"), 1_700_000_000)) is None
    assert one(spark, schedule.jittered(F.lit(1000.0), F.lit(""), 5000.0)) == 1000
    assert 900 <= one(spark, schedule.jittered(F.lit(1000.0), F.lit("x"), 5000.0)) <= 1100
    assert [one(spark, schedule.freshness(F.lit(a).cast("int"), 10, 20)) for a in (10, 11, 20, 21, None)] == ["fresh", "soft_stale", "soft_stale", "hard_stale", "hard_stale"]


def test_repeats_claim_nothing_once_dropped(spark):
    rows = [(1, 1, "https://h/p/404-1-1.php", "A", 1, "u"), (2, 2, "https://h/p/406-1-1,r5.php", "B", 1, "u"), (3, 3, "https://h/3", "b", 1, "U"), (4, 4, "https://h/4", " a ", 1, "u")]
    df = spark.createDataFrame(rows, "rank int, id int, canonical_url string, title string, published_day int, unit string")
    assert [r.id for r in announcements.without_repeats(df, 10).orderBy("rank").collect()] == [1, 3]
    assert announcements.without_repeats(df.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        announcements.selected(df, day_from=2, day_to=1)


def test_heading_chunks(spark):
    t = "x" * 60 + "\n# head\n" + "y" * 80
    assert [c for c, _, _ in documents.heading_cuts(t, 100, 10)] == ["x" * 60, "x" * 9 + "\n# head\n" + "y" * 80]
    assert documents.heading_cuts("z" * 150, 100, 10) == [("z" * 100, 0, 100), ("z" * 60, 90, 150)]
    assert documents.heading_cuts("", 10, 2) == []
    docs = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id for r in documents.heading_chunks(docs, 100, 10).collect()} == {1}


def test_frontier_equals_one_by_one(spark):
    arrivals = [(i, f"h{i * i % 5}") for i in range(120)]
    pending = {"h0": 3, "h1": 9}
    kept, taken, total = [], dict(pending), sum(pending.values())
    for i, h in arrivals:
        if taken.get(h, 0) < 10 and total < 30:
            kept.append(i)
            taken[h] = taken.get(h, 0) + 1
            total += 1
    got = sitegraph.frontier(spark.createDataFrame([(*a, False, True) for a in arrivals], "position int, host string, known boolean, is_indexable boolean"), spark.createDataFrame(list(pending.items()), "host string, pending int"), 10, 30)
    assert sorted(r.position for r in got.collect()) == kept


def test_due_needs_a_due_time_and_a_free_host(spark):
    cols = "page_id long, url string, host string, is_active boolean, is_indexable boolean, crawl_status string, crawl_priority int, next_crawl_s long, minimum_depth int, failure_count int, lease_expires_s long, lease_owner string"
    base = lambda i, host, due, lease=None, depth=0, url="http://a/x": (i, url, host, True, True, "success", i, due, depth, 0, lease, "w" if lease else None)
    pages = spark.createDataFrame([base(1, "a", 5), base(2, "a", 5), base(3, "b", None), base(4, "c", 5), base(5, "c", 5, 99), base(6, "d", 5, 9), base(7, "e", 5, None, 4), base(8, "f", 5, None, 0, "http://a/x.pdf")], cols)
    due = crawling.due(pages, 10, 10)
    assert sorted(r.page_id for r in due.collect()) == [2, 6]
    again = crawling.claimed(pages, due, "me", 10, 5)
    assert sorted(r.page_id for r in again.where("lease_owner = 'me' and lease_expires_s = 15").collect()) == [2, 6]


def limiter(rows, limit, width):
    out, kept = {}, {}
    for u, e, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        k = kept.setdefault(u, deque())
        while k and k[0] <= at - width:
            k.popleft()
        out[e] = len(k) < limit
        if out[e]:
            k.append(at)
    return out


def test_rate_limit(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i % 3, i, (i * 37) % 500) for i in range(200)]
    df = spark.createDataFrame([(u, e, start + datetime.timedelta(seconds=s)) for u, e, s in rows], "user_id long, event_id long, ts timestamp")
    assert {r.event_id: r.allowed for r in conversation.rate_limited(df, 4, 60).collect()} == limiter(rows, 4, 60)


def test_html_reader():
    page = "<html><head><title>T</title><meta property='og:title' content='Best'><meta name='date' content='2024-01-02'></head><body><nav><a href='/n'>N</a>menu</nav><main><h1>H</h1><p>one <b>two</b></p><script>var x='</p>'</script><p hidden>no</p><a href='x#y'>go</a><a href='x'>again</a></main>foot</body>"
    got = html.read(page, "http://h/d/")
    assert (got["title"], got["dates"]) == ("Best", ["2024-01-02"])
    assert got["body"] == "H\none\ntwo\ngo\nagain"
    assert got["links"] == [{"url": "http://h/n", "label": "N"}, {"url": "http://h/d/x#y", "label": "go"}, {"url": "http://h/d/x", "label": "again"}]
    assert html.read(None, None)["body"] == "" and html.read("<p <<>>x</q>", "u")["title"] == ""


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id long, x string")
    sinks.json_lines(df, str(tmp_path / "j"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "j")).count() == 2
    assert spark.read.parquet(sinks.snapshot(df, str(tmp_path / "s"), 3)).count() == 2
    assert "| 1 | a/b |" in sinks.markdown(df.orderBy("id"), "T")


def test_alias_normalize(spark):
    df = spark.createDataFrame([(" see the CS dept ",), (None,)], "t string")
    got = [r.x for r in df.select(resolution.normalized(F.col("t"), [("CS", "Computing"), ("CS dept", "Computing Department")]).alias("x")).collect()]
    assert got == ["see the Computing Department", None]


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title> A </title><link>http://a</link><pubDate>d</pubDate></item><item><title>no link</title></item></channel></rss>")
    assert [(r.title, r.link) for r in files.feed(spark, str(tmp_path / "feed.xml")).collect()] == [("A", "http://a")]


def test_scope_and_confidence(spark):
    rows = spark.createDataFrame([("https://h/", "u"), ("https://x/", "v"), ("https://k/p", "w"), ("https://kk/", "w")], "canonical_url string, unit string")
    boost = retrieval.boost(retrieval.Scope("https://h/", "v", ("k",)))
    assert [r.b for r in rows.select(boost.alias("b")).collect()] == [0.40, 0.24, 0.18, 0.0]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400)
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    # The last events are judged once the watermark has passed them: a much later one moves it.
    last = events.agg(F.max("ts")).first()[0]
    late = spark.createDataFrame([(10**9, last + datetime.timedelta(days=400), 10**6)], "event_id long, ts timestamp_ntz, user_id long")
    for c in events.columns:
        late = late if c in late.columns else late.withColumn(c, F.lit(None).cast(events.schema[c].dataType))
    late.select(events.columns).write.mode("append").parquet(str(tmp_path / "late"))
    spark.conf.set(*state.STORE)
    both = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).union(spark.readStream.schema(events.schema).parquet(str(tmp_path / "late")))
    run = state.rate_limits(both, 3, 6 * 3600).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "in"))
    batch = {r.event_id: r.allowed for r in conversation.rate_limited(stored, 3, 6 * 3600).collect()}
    assert {r.event_id: r.allowed for r in spark.table("limited").where("event_id < 1000000000").collect()} == batch

    state.into_snapshots(stream.select("user_id", "event_id", "ts"), str(tmp_path / "snap"), "user_id", "event_id", str(tmp_path / "c2")).awaitTermination(120)
    latest = spark.read.parquet(str(tmp_path / "snap" / "0"))
    want = {r.user_id: r.event_id for r in stored.groupBy("user_id").agg(F.max("event_id").alias("event_id")).collect()}
    assert {r.user_id: r.event_id for r in latest.collect()} == want

    attempts = stream.selectExpr("event_type as outcome", "ts as started_at")
    windows = state.outcome_windows(attempts.withColumn("started_at", F.col("started_at").cast("timestamp"))).writeStream.format("memory").outputMode("complete").queryName("hours").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    windows.awaitTermination(120)
    assert sum(r.attempts for r in spark.table("hours").collect()) == stored.count()
    lives = state.expiring_sessions(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName("lives").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    lives.awaitTermination(120)
    assert all(r.ends > r.begins for r in spark.table("lives").collect())


def test_payloads_lose_sensitive_fields(spark):
    told = ['{"a":1,"Auth_Token":{"x":2},"list":[{"PASSWORD":"p","b":["é"]}]}', '{"a":"my token"}', "[1,2]", "no json token", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", payloads.redacted(F.col("t")).alias("r")).collect()}
    assert got == {0: '{"a":1,"Auth_Token":"[REDACTED]","list":[{"PASSWORD":"[REDACTED]","b":["é"]}]}', 1: '{"a":"my token"}', 2: "[1,2]", 3: None, 4: None}
