import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from spindrift.llm import warc
from spindrift.llm.common import shared_dir

ROWS = [(1, "http://a/", "<p>x</p>", "r"), (2, "http://b/", "<p>x</p>", "r"), (7, None, "<p>x</p>", "r"), (3, "http://c/ d\r\nX: y", None, "r"), (4, "http://d/", "", "r"), (5, "http://e/", "a\r\n\r\nWARC/1.1\r\n\r\n", "r"), (6, "http://f/", "é😀" * 200_000, "r"), (None, "http://g/", "<p>x</p>", "r"), (8, "u", "\r\n\r\n", "r"), (8, "u", "\r\n\r\n", "r"), (10, "u", "a\r\n", "r"), (11, "u", "\r\n", "r"), (12, "u", "\r\n\r\n\r\nWARC/1.1\r\n\r\n\r\n", "r"), (13, "u", "\n\r\n\r", "r")]
SCHEMA = "page_id long, url string, html string, record_type string"


def brute(rows, least=0):
    out = []
    for i, _, html, _ in rows:
        p = (html or "").encode()
        top = max((j for j, _, h, _ in rows if j is not None and (h or "").encode() == p), default=None)
        revisit = len(p) >= least and i is not None and i < top
        out.append((i or 0, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_against_brute_force(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = [(r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op9(pages, least).collect()]
    assert sorted(got, key=str) == brute(ROWS, least)
    assert warc.op9(pages.where(F.lit(False))).count() == 0


def test_payloads_round_trip(spark):
    path = f"{shared_dir(spark)}/round-trip"
    warc.archive(spark.createDataFrame(ROWS, SCHEMA).where("page_id is not null"), path)
    recs = warc.read(spark, path, payloads=True).collect()
    stored = {r.page_id: r.payload.decode() for r in recs if r.payload is not None}
    for r in recs:
        want = next(h or "" for i, _, h, _ in ROWS if i == r.page_id)
        assert stored[r.refers_to or r.page_id] == want
        assert r.url is None or "\n" not in r.url


def test_broken_archives_are_refused():
    good = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for parts in ([good * 2], [good, good], [good[:9], good[9:] + good[:30], good[30:]], [bytes([b]) for b in good * 2]):
        assert [b for _, b in warc.parse(parts)] == [b"abc"] * 2
    assert [b for _, b in warc.parse([good[:-4]], b"\r\n\r\n")] == [b"abc"]
    for bad in (good[:-3], b"x" + good, good + b"\n", good[:10]):
        with pytest.raises(ValueError):
            list(warc.parse([bad]))


def test_a_missing_response_is_an_error(spark):
    path = f"{shared_dir(spark)}/missing"
    pages = spark.createDataFrame([(1, "u", "same", "r"), (2, "u", "same", "r")], SCHEMA)
    warc.archive(pages, path)
    only = warc.read(spark, path).where("record_type = 'revisit'")
    with pytest.raises(Exception, match="lack the response of page 2"):
        warc.resolved(only).collect()


def test_one_payload_on_most_pages(spark):
    rows = [(i, "u", None if i % 3 else f"p{i}", "r") for i in range(1500)] + [(1, "u", None, "r")] * 600
    pages = spark.createDataFrame(rows, SCHEMA)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op9(pages).collect()]
    top = {"": 1499}
    assert len(got) == len(rows) and sum(r[3] == "revisit" for r in got) == 999 + 600
    assert all(r[4] == top[""] for r in got if r[3] == "revisit")


def test_a_page_id_repeats_with_other_payloads(spark):
    rows = [(5, "u", "A", "r"), (5, "u", "B", "r"), (9, "u", "A", "r"), (9, "u", "C", "r"), (2, "u", "C", "r"), (3, "u", "A", "r")]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op9(pages).collect()]
    assert sorted(got, key=str) == brute(rows)
    path = f"{shared_dir(spark)}/repeats"
    warc.archive(pages, path)
    assert sorted(r.payload.decode() for r in warc.read(spark, path, payloads=True).collect() if r.payload is not None) == ["A", "B", "C"]
