"""Tables drawn from fitted models, and models as JSON files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distributions as D
from ..operators.distributions import Stored, from_dict
from ..operators.mixture import BayesMixin


def sample(spark: SparkSession, model, n: int, cols: list[str], seed: int = 0, partitions: int = 8) -> DataFrame:
    """(id, columns...): n rows from any model with ``draw``; a block of 4096 ids has a generator of its own, so a lost task draws the same."""
    block = 4096

    def run(batches):
        for b in batches:
            for k in b["id"]:
                size = min(block, n - int(k) * block)
                x = np.asarray(model.draw(np.random.default_rng((seed, int(k))), size), float)
                yield pd.DataFrame({"id": np.arange(size) + int(k) * block} | {c: x[:, j] for j, c in enumerate(cols)})

    return spark.range(0, -(-n // block), 1, partitions).mapInPandas(run, "id long, " + ", ".join(f"{c} double" for c in cols))


def sample_sequences(spark: SparkSession, model, n: int, length: int, cols: list[str], seed: int = 0, partitions: int = 8) -> DataFrame:
    """(seq, t, state, columns...) from a hidden Markov model."""
    block = 512

    def run(batches):
        for b in batches:
            for k in b["id"]:
                size = min(block, n - int(k) * block)
                path, x = model.draw(np.random.default_rng((seed, int(k))), size, length)
                s, t = np.nonzero(path >= 0)
                yield pd.DataFrame({"seq": s + int(k) * block, "t": t, "state": path[s, t]} | {c: x[s, t, j] for j, c in enumerate(cols)})

    return spark.range(0, -(-n // block), 1, partitions).mapInPandas(run, "seq long, t int, state int, " + ", ".join(f"{c} double" for c in cols))


def uniform(key: str, seed: int, stream: int = 0):
    """A number in (0, 1) for each value of a key column, from the first 52 bits of an md5: the same on any cluster and in any SQL engine."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(stream))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sample_columns(df: DataFrame, model, key: str, cols: list[str], seed: int = 0) -> DataFrame:
    """Adds one draw from a model to each row, as column expressions over uniform(): nothing leaves the JVM.

    For Bernoulli, Categorical, Exponential, Uniform, the diagonal Gaussians, IndependentComponents and mixtures of these;
    others raise ValueError and go through sample().
    """
    draws = _draws(model, key, len(cols), seed, 0)
    return df.select("*", *[d.alias(c) for d, c in zip(draws, cols)])


def _draws(model, key, d, seed, stream) -> list:
    if isinstance(model, D.IndependentComponents):
        return [_draws(m, key, 1, seed, stream + 2 * j)[0] for j, m in enumerate(model.distributions)]
    if isinstance(model, BayesMixin):
        parts = [_draws(m, key, d, seed, stream + 2 * d * (i + 1)) for i, m in enumerate(model.distributions)]
        u, cut = uniform(key, seed, stream), np.cumsum(model._priors())
        out = parts[-1]
        for i in range(model.k - 2, -1, -1):
            out = [F.when(u < float(cut[i]), a).otherwise(b) for a, b in zip(parts[i], out)]
        return out
    return [_draw(model, j, uniform(key, seed, stream + 2 * j), uniform(key, seed, stream + 2 * j + 1)) for j in range(d)]


def _draw(m, j: int, u, v):
    if isinstance(m, D.Bernoulli):
        return F.when(u < float(m.probs[j]), 1.0).otherwise(0.0)
    if isinstance(m, D.Categorical):
        cut = np.cumsum(m.probs[j])[:-1]
        return sum((F.when(u >= float(c), 1.0).otherwise(0.0) for c in cut[1:]), F.when(u >= float(cut[0]), 1.0).otherwise(0.0)) if len(cut) else F.lit(0.0)
    if isinstance(m, D.Exponential):
        return F.log(u) * float(-m.scales[j])
    if isinstance(m, D.Uniform):
        return u * float(m.maxs[j] - m.mins[j]) + float(m.mins[j])
    if type(m) in (D.Normal, D.LogNormal, D.HalfNormal) and m.covariance_type != "full":
        z = F.sqrt(F.log(u) * -2.0) * F.cos(v * float(2 * np.pi)) * float(np.sqrt(m.covs[j])) + float(m.means[j])
        return F.exp(z) if type(m) is D.LogNormal else F.abs(z) if type(m) is D.HalfNormal else z
    raise ValueError(f"{type(m).__name__} has no draw as a column expression")


def sample_chains(spark: SparkSession, model, n: int, length: int, seed: int = 0, partitions: int = 8) -> DataFrame:
    """(seq, t, x) from a Markov chain over one column."""
    block = 512

    def run(batches):
        for b in batches:
            for k in b["id"]:
                size = min(block, n - int(k) * block)
                x = model.draw(np.random.default_rng((seed, int(k))), size, length)
                yield pd.DataFrame({"seq": np.repeat(np.arange(size) + int(k) * block, length), "t": np.tile(np.arange(length), size), "x": x.ravel()})

    return spark.range(0, -(-n // block), 1, partitions).mapInPandas(run, "seq long, t int, x int")


def sample_given(df: DataFrame, model, parents: list[str], out: str, key: str, seed: int = 0) -> DataFrame:
    """Adds a draw from a conditional table for the parents of each row; ``key`` names the row, so a lost task draws the same."""
    cut = np.cumsum(model.probs, -1)
    at = F.lit(0)
    for k, c in zip(model.probs.shape[:-1], parents):
        at = at * int(k) + F.col(c).cast("int")
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in cut.reshape(-1, cut.shape[-1])])
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    drawn = F.least(F.size(F.filter(F.element_at(rows, at + 1), lambda v: v < u)), F.lit(cut.shape[-1] - 1))
    return df.withColumn(out, drawn)


def save(model: Stored, path: str) -> None:
    with open(path, "w") as f:
        f.write(model.to_json())


def load(path: str) -> Stored:
    import json

    with open(path) as f:
        return from_dict(json.load(f))
