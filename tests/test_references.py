"""Character references that the end of a text cuts short, against the queries' SQL."""

import duckdb
import pytest

from spindrift.catalog import ORACLES, QUERIES
from spindrift.sources.markup import attributes, ended, events
from test_catalog import rows

#: What is left of a reference at the end of a heading.
CUT = ["&amp;&amp", "&am", "&a", "&", "&quot", "&lt;b&gt", "&copy", "&middot", "&#x27", "x &amp;amp", "&amp;lt;", "&quot;q&quot;"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    made = [(i, f"https://example.org/{i}", f"<html><head><title>T {c}</title></head><body><nav>no</nav><article><h1>{'' if i % 7 == 3 else 'H ' + c}</h1><p>Some words {c}</p></article></body></html>") for i, c in enumerate(CUT * 5)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(f"file://{path}/pages.parquet")
    return path


def differing(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{sf}/pages.parquet/*.parquet'")
    got, want = QUERIES[name](spark, f"file://{sf}"), c.execute(ORACLES[name])
    a, b = rows(got.columns, got.collect()), rows([d[0] for d in want.description], want.fetchall())
    return len(a) - len(b), set(a) ^ set(b)


def test_only_ended_references_are_decoded():
    assert ended("&amp;&amp &lt;&#65;&#x42;&#66 &notit; &nosuch; &") == "&&amp <AB&#66 &notit; &nosuch; &"
    assert [x for _, x, _ in events("<title>a&amp</title>b&amp", ended)] == ["title", "a&amp", "title", "b&amp"]
    assert [x for _, x, _ in events("<title>a&amp</title>b&amp")] == ["title", "a&", "title", "b&"]
    assert attributes(" a='x&amp;y&amp'", ended) == {"a": "x&y&amp"}


def test_html_clean(spark, sf):
    assert differing(spark, sf, "html_clean") == (0, set())


def test_html_detail(spark, sf):
    assert differing(spark, sf, "html_detail") == (0, set())


def test_html_page(spark, sf):
    assert differing(spark, sf, "html_page") == (0, set())


def test_html_title(spark, sf):
    assert differing(spark, sf, "html_title") == (0, set())
