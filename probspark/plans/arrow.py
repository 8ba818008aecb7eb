"""Additive statistics by Arrow kernels, for models too wide for a column expression a statistic."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many aggregates stay in the JVM; beyond, expressions cost more to compile than the kernel to run.
WIDE = 300
#: Rows that a kernel sees at a time.
ROWS = 8192


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns of a batch as a (rows, columns) array of doubles, nulls as NaN."""
    out = np.empty((batch.num_rows, len(names)))
    for j, c in enumerate(names):
        out[:, j] = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out


def summed(df: DataFrame, cols: list[str], weights: list[Column], kernel: Callable[..., dict[str, float]], extra: list[Column] = ()) -> dict[str, float]:
    """The statistics that ``kernel`` gives for arrays (X, W) or (X, W, extra), over all rows: each task hands on one row a statistic.

    Statistics named min... and max... are merged by their extremes, all others by sums.  Weights alike in all columns are
    sent once.
    """
    x, e = [f"x{j}" for j in range(len(cols))], [f"e{j}" for j in range(len(extra))]
    same = all(w is weights[0] for w in weights)
    w = ["w0"] if same else [f"w{j}" for j in range(len(cols))]

    def run(batches):
        out: dict[str, float] = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                X = matrix(part, x)
                args = [X, np.broadcast_to(matrix(part, w), X.shape), *([matrix(part, e)] if e else [])]
                for k, v in kernel(*args).items():
                    out[k] = v if k not in out else combine(k, out[k], v)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([float(v) for v in out.values()], pa.float64())], ["k", "v"])

    wide = df.select(
        *[F.col(c).cast("double").alias(n) for c, n in zip(cols, x)],
        *[c.cast("double").alias(n) for c, n in zip(weights, w)],
        *[c.cast("double").alias(n) for c, n in zip(extra, e)],
    )
    return collected(wide.mapInArrow(run, "k string, v double"))


def combine(key: str, a: float, b: float) -> float:
    return min(a, b) if key.startswith("min") else max(a, b) if key.startswith("max") else a + b


def collected(parts: DataFrame) -> dict[str, float]:
    """Rows (k, v) of all tasks merged in the cluster: one row a statistic reaches the driver."""
    rows = parts.groupBy("k").agg(F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    return {r["k"]: r["lo"] if r["k"].startswith("min") else r["hi"] if r["k"].startswith("max") else r["s"] for r in rows}
