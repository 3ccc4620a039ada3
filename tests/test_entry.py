"""The driver's contract, at the smallest scale."""

import __spark_entry__ as e


def test_names():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["query", "doc", "sim", "rank"] and df.limit(1).count() == 1
