"""Views and their queries on small tables made for them."""

from spindrift.catalog import QUERIES
from spindrift.plans.views import view


def documents(spark, tmp_path, rows):
    spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_chunks_cover_whole_texts(spark, tmp_path):
    long = " ".join(f"zq{i}" for i in range(900))
    late = "zzzz " * 300 + "the and of that"
    sf = documents(spark, tmp_path, [(1, long, "src1"), (2, late, "src2"), (3, "", "src3"), (4, None, "src3"), (5, "x" * 400, "src3"), (6, "y" * 401, "src3")])
    chunks = {}
    for r in view(spark, sf, "d_chunks").orderBy("chunk_id").collect():
        chunks.setdefault(r.document_id, []).append(r.content)
    assert {d: len(c) for d, c in chunks.items() if d > 2} == {3: 1, 4: 1, 5: 1, 6: 2}
    whole = chunks[1][0] + "".join(c[80:] for c in chunks[1][1:])
    assert whole == long
    assert [r.document_id for r in QUERIES["keyword_topk"](spark, sf).collect()] == [2]


def test_announcements_hold_whole_texts(spark, tmp_path):
    late = "zzzz " * 300 + "the end"
    sf = documents(spark, tmp_path, [(1, late, "src4"), (2, "zzzz " * 300, "src4"), (3, None, "src4")])
    assert {r.id: r.body for r in view(spark, sf, "d_announcements").collect()} == {1: late, 2: "zzzz " * 300, 3: None}
    assert [r.total for r in QUERIES["ann_total"](spark, sf).collect()] == [1]


def test_versions_differ_by_whole_texts(spark, tmp_path):
    head = "shared header " * 20
    sf = documents(spark, tmp_path, [(1, head + "one", "src1"), (401, head + "two", "src1"), (601, head + "one", "src1")])
    got = {r.seq: (r.version, r.supersedes, r.is_current) for r in QUERIES["version_chain"](spark, sf).collect()}
    assert got == {1: (1, None, False), 401: (2, 1, True)}


def test_links_reach_every_page(spark, tmp_path):
    pages = [(i, f"https://h{i % 9}.example.org/{i}", f"<title>page {i}</title>") for i in range(500)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    links = view(spark, str(tmp_path), "d_links").collect()
    assert len(links) == 3000 and {r.target_page_id for r in links} == set(range(500))
    assert all(r.target_page_id == (r.source_page_id * 7 + r.k) % 500 for r in links)
