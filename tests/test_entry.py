import __spark_entry__


def test_entry_has_rows_and_a_stable_schema(spark):
    a, b = __spark_entry__.entry(spark), __spark_entry__.entry(spark)
    assert a.schema == b.schema and a.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
