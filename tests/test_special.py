"""The special functions to the last digits, in numpy and as columns, and what is rounded from them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from probspark.functions import exprs as E
from probspark.functions import special

X = [1e-3, 0.3, 1.0, 1.5, 1.7, 2.0, 5.25, 8.0, 51.0, 1000.0]


def test_lgamma(spark):
    want = np.array([math.lgamma(x) for x in X])
    assert np.allclose(special.lgamma(X), want, rtol=1e-14, atol=1e-13)
    got = spark.createDataFrame([(x,) for x in X], "x double").select(E.lgamma(F.col("x")).alias("y"), "x").collect()
    assert np.allclose([r["y"] for r in got], [math.lgamma(r["x"]) for r in got], rtol=1e-14, atol=1e-13)


def test_digamma_and_trigamma():
    assert np.allclose(special.digamma([1.0, 0.5]), [-0.5772156649015329, -1.9635100260214235], rtol=0, atol=1e-13)
    assert np.allclose(special.trigamma([1.0, 0.5]), [math.pi**2 / 6, math.pi**2 / 2], rtol=0, atol=1e-12)


def test_gamma_scores_near_a_half_of_the_last_digit(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 239.96), (2, 440.08), (3, 559.6), (4, 562.95), (5, 0.0)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["gamma_logp"]).fetchall()
    assert sorted(tuple(r) for r in entry.queries()["gamma_logp"](spark, str(tmp_path)).collect()) == sorted(want)
