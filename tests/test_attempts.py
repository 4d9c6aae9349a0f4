"""The attempt log, its fold, and commits of several tables."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import attempts, crawling, fetched, sitegraph
from spindrift.sources.sinks import LostWriter, Tables

SCHEMA = "page_id long, at_s long, seq long, event string, owner string, token string, seconds long, status string, next_s long, changed boolean, http_status int, deactivate boolean"


def row(page, at, event, owner="w", token="t", seconds=10, status=None, next_s=None, changed=None, http=None, off=False, seq=None):
    return (page, at, at if seq is None else seq, event, owner, token, seconds, status, next_s, changed, http, off)


def replay(spark, rows, pages=None):
    return attempts.replayed(spark.createDataFrame(rows, SCHEMA), pages)


def outcomes(replayed):
    return {(r.page_id, r.token): (r.owner, r.started_s, r.finished_s, r.outcome) for r in attempts.attempts(replayed).collect()}


def states(replayed, pages=None):
    return {r.page_id: r for r in attempts.states(replayed, pages).collect()}


def test_life_of_a_lease(spark):
    log = [
        row(1, 0, "claim"), row(1, 5, "claim", token="u"), row(1, 8, "renew"), row(1, 17, "complete", status="success", next_s=99, changed=True, http=200), row(1, 18, "complete", status="failed"),
        row(1, 20, "claim", token="v"), row(1, 25, "fail", token="v", status="blocked", next_s=120, http=403),
        row(2, 0, "claim"), row(2, 10, "renew"), row(2, 11, "claim", owner="x", token="u"), row(2, 12, "complete", status="success"), row(2, 13, "complete", owner="x", token="u", status="unchanged", changed=False, http=304),
        row(3, 0, "claim"), row(3, 1, "fail", owner="thief", status="failed"), row(3, 2, "fail", status="excluded", off=True),
        row(4, 0, "claim"), row(5, 0, "complete", status="success"), row(6, 0, "dance"),
    ]
    random.Random(1).shuffle(log)
    got = replay(spark, log).cache()
    assert outcomes(got) == {
        (1, "t"): ("w", 0, 17, "success_changed"), (1, "v"): ("w", 20, 25, "blocked"), (2, "t"): ("w", 0, 10, "lease_lost"), (2, "u"): ("x", 11, 13, "not_modified"),
        (3, "t"): ("w", 0, 2, "excluded"), (4, "t"): ("w", 0, None, "running"),
    }
    after = states(got)
    assert (after[1].crawl_status, after[1].failure_count, after[1].changed_streak, after[1].last_success_s, after[1].next_crawl_s) == ("blocked", 1, 1, 17, 120)
    assert (after[2].crawl_status, after[2].unchanged_streak, after[2].failure_count) == ("unchanged", 1, 0)
    assert not after[3].is_active and after[4].lease_expires_s == 10 and after[4].crawl_status == "fetching"
    assert after[5].crawl_status == "discovered" and after[6].crawl_status == "discovered"
    assert {r.outcome: r.attempts for r in attempts.reported(got, 10).collect()} == {"blocked": 1, "not_modified": 1}
    got.unpersist()


def test_a_log_may_be_folded_in_parts(spark):
    rng = random.Random(4)
    log = []
    for i in range(600):
        page, token = rng.randrange(6), f"t{rng.randrange(8)}"
        log.append(row(page, i, rng.choice(["claim", "claim", "renew", "complete", "fail"]), rng.choice("ab"), token, rng.randrange(1, 12), rng.choice(["success", "failed"]), i + 50, rng.choice([True, False, None]), 200, rng.random() < 0.1))
    whole = states(replay(spark, log))
    first = attempts.states(replay(spark, log[:300]))
    assert states(replay(spark, log[300:], first), first) == whole
    assert replay(spark, []).collect() == []


def test_one_second_goes_by_seq_and_partitions_do_not_matter(spark):
    log = [row(1, 5, "complete", status="success", seq=2), row(1, 5, "claim", seq=1), row(1, None, "claim", seq=0), row(None, 1, "claim")]
    a = spark.createDataFrame(log, SCHEMA)
    one, many = (sorted(map(tuple, attempts.replayed(a.repartition(n)).collect()), key=str) for n in (1, 9))
    assert one == many
    assert outcomes(attempts.replayed(a)) == {(1, "t"): ("w", 5, 5, "success_unchanged")}


def test_reports_are_fenced_by_token(spark):
    pages = spark.createDataFrame([(1, "w", "t", 100), (2, "w", "t", 100), (3, "w", "t", 5), (4, None, None, None)], "page_id long, lease_owner string, lease_token string, lease_expires_s long")
    reports = spark.createDataFrame([(i, "w", "t" if i != 2 else "old", "success") for i in range(1, 6)], "page_id long, lease_owner string, lease_token string, outcome string")
    got = {r.page_id: r.outcome for r in crawling.finished(pages, reports, 10).collect()}
    assert got == {1: "success", 2: "lease_lost", 3: "lease_lost", 4: "lease_lost", 5: "lease_lost"}


def test_busy_hosts_and_room(spark):
    cols = "page_id long, host string, url string, is_active boolean, is_indexable boolean, crawl_status string, next_crawl_s long, lease_expires_s long, minimum_depth int, crawl_priority int, failure_count int"
    free = lambda i, host, **k: (i, host, f"https://{host}/{i}", True, True, k.get("status", "queued"), k.get("next_s", 5), k.get("lease"), 0, i, 0)
    rows = [free(1, "a"), free(2, "a"), free(3, "b", lease=100), free(4, "b"), (5, "c", "https://c/5", False, True, "fetching", 5, 100, 0, 5, 0), free(6, "c"), free(7, "d", status="blocked"), free(8, "e", next_s=None)]
    pages = spark.createDataFrame(rows, cols)
    ids = lambda df: [r.page_id for r in df.collect()]
    assert ids(crawling.due(pages, 10, 9)) == [6, 2]  # an inactive page's lease keeps no host busy
    assert ids(crawling.due(pages, 10, 9, per_host=3, active=2)) == [6, 4, 2, 1]
    full = pages.withColumn("content_hash", F.lit("h")).withColumn("ingestion_status", F.when(F.col("page_id") < 3, "failed").otherwise("done")).withColumn("announcement_ingestion_status", F.when(F.col("page_id") == 8, "incomplete")).withColumn("lease_owner", F.lit("w"))
    s = crawling.status(full, 10).first()
    assert (s.due, s.pending, s.leased, s.blocked, s.ingestion_pending, s.ingestion_incomplete, s.workers, s.next_due_s) == (4, 5, 2, 1, 2, 1, 1, 5)
    assert {r.host: r.pending for r in crawling.host_pending(full).collect()} == {"a": 2, "b": 2, "c": 1, "e": 1, None: 6}


def test_frontier_equals_taking_targets_one_by_one(spark):
    rng = random.Random(2)
    arrivals = [(i, rng.choice("abc"), rng.random() < 0.3, rng.random() < 0.8) for i in range(60)]
    pending = {"a": 2, "b": 9}
    total, room, kept = sum(pending.values()), dict(pending), []
    for position, host, known, indexable in arrivals:
        if known or not indexable:
            kept.append(position)
        elif total < 25 and room.get(host, 0) < 10:
            kept.append(position)
            total += 1
            room[host] = room.get(host, 0) + 1
    df = spark.createDataFrame(arrivals, "position long, host string, known boolean, is_indexable boolean")
    got = sitegraph.frontier(df, spark.createDataFrame(list(pending.items()), "host string, pending long"), 10, 25)
    assert sorted(r.position for r in got.collect()) == sorted(kept)


def test_a_late_writer_leaves_nothing_behind(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    one, two = Tables(spark, folder), Tables(spark, folder)
    assert one.version() == 0 and one.names() == []
    assert one.commit({"pages": spark.range(3), "links": spark.range(1)}, 0) == 1
    began = two.version()
    assert one.commit({"pages": spark.range(5)}, 1) == 2
    with pytest.raises(LostWriter):
        two.commit({"pages": spark.range(100), "attempts": spark.range(7)}, began)
    assert two.version() == 2 and two.names() == ["links", "pages"]
    assert two.read("pages").count() == 5 and two.read("links").count() == 1 and two.read("pages", 1).count() == 3
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("data-")]) == 2


def test_a_failed_write_publishes_nothing(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/state")
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        t.commit({"good": spark.range(2), "bad": bad}, 0)
    assert t.version() == 0 and not [p for p in (tmp_path / "state").glob("data-*")]


def crawl(spark):
    cols = "page_id long, url string, title string, unit string, content_hash string, page_type string, discovery_source string, crawl_priority int, minimum_depth int, is_indexable boolean, lease_owner string, lease_token string, lease_expires_s long, crawl_status string, failure_count int, changed_streak int, unchanged_streak int, next_crawl_s long, last_success_s long, is_active boolean"
    page = lambda i, url, owner=None, token=None, until=None, status="queued": (i, url, f"old {i}", "u", "h0", "general_page", "manual", 5, 0, True, owner, token, until, status, 2, 0, 0, 1, None, True)
    pages = spark.createDataFrame([page(1, "https://example.org/", "w", "t", 100, "fetching"), page(2, "https://example.org/b", "v", "s", 5, "fetching"), page(3, "https://example.org/known")], cols)
    links = spark.createDataFrame([(1, 3, "first", "content", 7, 1)], "source_page_id long, target_page_id long, anchor_text string, link_type string, position long, seen_s long")
    reports = spark.createDataFrame([(*row(1, 10, "complete", "w", "t", status="success", next_s=900, changed=True, http=200), "New", "h1"), (*row(2, 10, "complete", "v", "s", status="success", next_s=900), "Stolen", "h2")], SCHEMA + ", title string, content_hash string")
    told = [(1, "t", 0, "/known", "again"), (1, "t", 1, "/new", ""), (1, "t", 2, "/new", "通知"), (1, "t", 3, "/file.pdf", "doc"), (1, "t", 4, "https://other.net/x", "off"), (1, "t", 5, "/more", "m"), (2, "s", 0, "/stolen", "s")]
    found = spark.createDataFrame([(s, t, p, u if "//" in u else f"https://example.org{u}", a, 0, False) for s, t, p, u, a in told], "source_page_id long, token string, position long, url string, anchor_text string, depth int, listed boolean")
    return pages, links, spark.createDataFrame([], SCHEMA), reports, found


def test_fetched_pages_are_one_change_behind_a_fence(spark, tmp_path):
    pages, links, log, reports, found = crawl(spark)
    out = fetched.persisted(pages, links, log, reports, found, 10, ["example.org"], most=3)
    got = {r.url: r for r in out["pages"].collect()}
    # Two pages wait after the report, so one of the new targets finds room, the first; documents need none.
    assert set(got) == {f"https://example.org/{p}" for p in ("", "b", "known", "new", "file.pdf")}
    one, two, new, doc = (got[f"https://example.org/{p}"] for p in ("", "b", "new", "file.pdf"))
    assert (one.title, one.content_hash, one.crawl_status, one.changed_streak, one.failure_count, one.lease_owner) == ("New", "h1", "success", 1, 0, None)
    assert (two.title, two.crawl_status, two.lease_owner) == ("old 2", "fetching", "v")
    assert (new.crawl_status, new.minimum_depth, new.next_crawl_s, new.is_active) == ("discovered", 1, 40, True) and (doc.crawl_status, doc.page_type) == ("excluded", "official_document")
    ids = {r.page_id: u for u, r in got.items()}
    edges = {(e.source_page_id, ids[e.target_page_id].rsplit("/", 1)[1]): (e.anchor_text, e.link_type, e.position) for e in out["links"].collect()}
    assert edges[1, "known"] == ("first", "content", 7) and edges[1, "new"][:2] == ("通知", "announcement") and edges[1, "file.pdf"][1] == "document"
    assert {s for s, _ in edges} == {1}
    # The log holds no claim of this round, so there is no attempt to end; a claim and a late report make one that is lost.
    log = spark.createDataFrame([row(2, 1, "claim", "v", "s", 4)], SCHEMA)
    free = pages.where("page_id <> 2").unionByName(pages.where("page_id = 2").withColumn("lease_expires_s", F.lit(0).cast("long")))
    lost = {r.page_id: r.outcome for r in fetched.persisted(free, links, log, reports, found, 10, ["example.org"])["attempts"].collect()}
    assert lost == {2: "lease_lost"}

    tables = Tables(spark, f"file://{tmp_path}/crawl")
    began = tables.commit({"pages": pages, "links": links, "attempts": out["attempts"].limit(0)}, 0)
    assert fetched.commit(tables, began, log.limit(0), reports, found, 10, ["example.org"]) == 2
    with pytest.raises(LostWriter):
        fetched.commit(tables, began, log.limit(0), reports, found, 11, ["example.org"])
    assert tables.version() == 2 and tables.read("pages").count() == 6 and tables.read("links").count() == 4


def test_of_two_writers_at_once_one_is_lost(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/state")
    other = Tables(spark, f"file://{tmp_path}/state")
    slow = {"pages": spark.range(9)}

    class Racing(dict):
        def items(self):  # the other writer commits while this one writes
            other.commit({"pages": spark.range(2)}, 0)
            return super().items()

    with pytest.raises(LostWriter):
        t.commit(Racing(slow), 0)
    assert t.version() == 1 and t.read("pages").count() == 2
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("data-")]) == 1
