import pytest
from pyspark.sql import functions as F

from spindrift.functions import tables, text

PAGE = "<body><h1>A</h1><p>one<p>two</p><a href='/x'>X</a><form action='/f' method=POST></form></body>"


def test_parts_have_columns_of_their_own(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, PAGE, "https://h/"), (2, None, None)], "page_id long, html string, url string")
    got = {part: spark.sql(f"select p.page_id, t.* from {{d}} p, lateral page_parts(p.html, p.url, '{part}') t order by position", d=df) for part in tables.PARTS}
    assert [tuple(r) for r in got["links"].collect()] == [(1, 0, "https://h/x", "X")]
    assert [tuple(r) for r in got["headings"].collect()] == [(1, 0, "A")]
    assert [r.line for r in got["lines"].collect()] == ["A", "one", "two", "X"]
    assert [tuple(r) for r in got["forms"].collect()] == [(1, 0, "https://h/f", "post")]
    assert got["items"].columns == ["page_id", "position", "url", "title", "told", "summary", "anchor_text"] and got["items"].collect() == []
    with pytest.raises(Exception, match="part must be one of"):
        spark.sql("select * from page_parts('', '', 'tables')").collect()


def test_embedders(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "é")], "id long, t string")
    rows = tables.embedded(df, "t", tables.HashEmbedder(40)).withColumn("same", text.hash_embedding(F.col("t"), 40)).collect()
    for r in rows:
        assert r.embedding is None if r.t is None else r.embedding == pytest.approx(r.same)

    class Broken:
        size = 3

        def embed(self, texts):
            return [[1.0] for _ in texts]

    with pytest.raises(Exception, match="1 components, not 3"):
        tables.embedded(df, "t", Broken()).collect()
    assert tables.embedded(df.limit(0), "t", tables.HashEmbedder()).collect() == []
