"""The driver contract: entry runs, every oracle has a query."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 150
    assert "Turnout_Share_Flag" in df.columns


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
