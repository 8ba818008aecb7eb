"""Contingency counts for many column sets in one scan."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many combinations of all columns are counted once and summed to the wanted tables by the driver.
PATTERNS = 1 << 17
#: Cells of one table, and of all tables together, at most.
CELLS = 1 << 24


def contingency(df: DataFrame, sets: list[tuple[str, ...]], cards: dict[str, int], weight: Column | None = None) -> dict[tuple[str, ...], np.ndarray]:
    """Weighted counts of each set of columns (codes from 0).  Rows with a null in a set are left out of that set.

    With few possible patterns of all columns one groupBy counts them, and the driver sums them up; otherwise each task
    counts its rows in all tables at once and the tables are summed in the cluster, so that no row is copied for a table.
    Codes beyond ``cards`` raise ValueError, as do tables of more than ``CELLS`` cells.
    """
    names = sorted({c for s in sets for c in s})
    size = {s: math.prod(cards[c] for c in s) for s in sets}
    if sum(size.values()) > CELLS:
        raise ValueError(f"tables of {sum(size.values())} cells; at most {CELLS} are counted")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    df = df.select(*[F.col(c).cast("int").alias(c) for c in names], w.alias("w_"))
    beyond = F.lit(False)
    for c in names:
        beyond = beyond | F.coalesce((F.col(c) < 0) | (F.col(c) >= cards[c]), F.lit(False))
    out = {s: np.zeros([cards[c] for c in s]) for s in sets}
    if math.prod(cards[c] + 1 for c in names) <= PATTERNS:
        rows = df.groupBy(*[F.when(~beyond, F.col(c)).alias(c) for c in names], beyond.alias("beyond_")).agg(F.sum("w_").alias("n_")).collect()
        if any(r["beyond_"] for r in rows):
            raise ValueError("codes beyond the tables")
        for s in sets:
            for r in rows:
                at = tuple(r[c] for c in s)
                if None not in at:
                    out[s][at] += r["n_"] or 0.0
        return out
    edge = np.concatenate([[0], np.cumsum([size[s] for s in sets])]).tolist()
    shape = [tuple(cards[c] for c in s) for s in sets]

    def run(batches):
        total, wrong = np.zeros(edge[-1]), 0
        for b in batches:
            x = {c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names}
            wt = b.column("w_").to_numpy(zero_copy_only=False).astype(float)
            wrong += sum(int(((v < 0) | (v >= cards[c])).sum()) for c, v in x.items())
            if wrong:
                continue
            for k, s in enumerate(sets):
                ok = ~np.isnan(wt)
                for c in s:
                    ok &= ~np.isnan(x[c])
                at = np.ravel_multi_index(tuple(x[c][ok].astype(int) for c in s), shape[k])
                total[edge[k] : edge[k + 1]] += np.bincount(at, wt[ok], edge[k + 1] - edge[k])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], float(wrong)))], ["i", "v"])

    flat = np.zeros(edge[-1])
    for r in df.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        if r["i"] >= 0:
            flat[r["i"]] = r["v"]
        elif r["v"]:
            raise ValueError("codes beyond the tables")
    return {s: flat[edge[k] : edge[k + 1]].reshape(shape[k]) for k, s in enumerate(sets)}
