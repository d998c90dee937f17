import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "verdict" in df.columns
