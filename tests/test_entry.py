import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 2
    assert df.columns == ["word", "id", "cnt"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_queries_are_callables():
    assert all(callable(f) for f in E.queries().values())
