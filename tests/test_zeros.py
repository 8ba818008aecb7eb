"""Queries over events on a table with zeros among the values, against their SQL."""

import math

import pytest

import __spark_entry__ as entry

VALUES = [3.0, 55.0, 0.0, 8.25, 20.5, 1.01, 140.0, 0.0, 61.0]


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("zeros"))
    spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "event_id long, value double").write.parquet(f"{at}/events.parquet")
    return at


def both(spark, sf, name):
    """Rows of the query and of its SQL, in one order; what is not a number is written out."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, sf).collect()]
    plain = lambda rows: sorted([tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows], key=repr)
    return plain(got), plain(want)


def test_lognormal_logp(spark, zeros):
    got, want = both(spark, zeros, "lognormal_logp")
    assert got == want and len(got) == len(VALUES)


def test_gamma_fit_mean(spark, zeros):
    got, want = both(spark, zeros, "gamma_fit_mean")
    assert got == want and got[0][1] == round(sum(VALUES) / len(VALUES), 4)


def test_mixture_batches(spark, zeros):
    """The logarithm of zero is minus infinity, not missing."""
    got, want = both(spark, zeros, "mixture_batches")
    assert got == want


def test_mixture_fit(spark, zeros):
    """The cluster that an infinite value has carried off is no component."""
    got, want = both(spark, zeros, "mixture_fit")
    assert got == want and len(got) == 1


def test_mixture_incremental(spark, zeros):
    got, want = both(spark, zeros, "mixture_incremental")
    assert got == want
