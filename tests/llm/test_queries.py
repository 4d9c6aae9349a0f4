import re

import __spark_entry__
import duckdb
import pytest

SF = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name,key", [("op9_warc", ["page_id"]), ("op10_urlrules", ["page_id"]), ("op11_orchard", ["vec_id"]), ("op12_divergence", ["lang", "source", "part", "rank"])])
def test_against_sql(spark, name, key):
    c = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = c.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    plain = lambda df: df[order].astype(object).where(df[order].notna(), None).sort_values(key).astype(str).to_numpy().tolist()
    fix = lambda rows: [[x.removesuffix(".0") for x in r] for r in rows]
    assert fix(plain(got)) == fix(plain(want))
