"""The registry holds, with SQL for each query that SQL can express."""

import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 25


def test_flagship(spark):
    assert entry.entry(spark).columns == ["l_orderkey", "l_linenumber", "lp"]
