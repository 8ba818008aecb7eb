"""Distributions over the columns of a DataFrame.

Each is a value: fitting returns a new one.  Training is additive: ``stats`` gives aggregate columns that are linear in the
weights (but for Uniform's minima and maxima), so one aggregation with partial and final steps fits any of them, batches
merge by adding rows, and mixtures, classifiers and hidden Markov models reuse the same statistics with other weights.
``logp`` is a projection that stays in the JVM; ``logp_np`` and ``stats_np`` do the same on numpy arrays for the models that
need Arrow kernels.  Null cells (NaN in numpy) are missing: they count for nothing, in scores and statistics.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.special import digamma, lgamma, logsumexp, safe_log, trigamma
from ..plans import arrow

EPS = 1e-300
KINDS: dict[str, type] = {}


def check(name: str, x, low=None, high=None, total=None) -> np.ndarray:
    """A parameter as an array, or ValueError if it breaks its bounds; what is not a number breaks none."""
    x = np.asarray(x, float)
    if low is not None and (x < low).any() or high is not None and (x > high).any():
        raise ValueError(f"{name} must lie between {low} and {high}")
    if total is not None and not (np.isnan(x.sum(-1)) | np.isclose(x.sum(-1), total, atol=1e-6)).all():
        raise ValueError(f"{name} must sum to {total}")
    return x


def blend(old, new, inertia: float):
    """inertia * old + (1 - inertia) * new; infinite entries are taken over."""
    if old is None or inertia == 0:
        return np.asarray(new, float)
    old, new = np.asarray(old, float), np.asarray(new, float)
    with np.errstate(invalid="ignore"):
        out = inertia * old + (1 - inertia) * new
    return np.where(np.isinf(old), old, np.where(np.isinf(new), new, out))


class Stored:
    """Models as plain values: any of them goes to JSON and back by from_dict()."""

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        KINDS[cls.__name__] = cls

    def to_dict(self) -> dict:
        return {"kind": type(self).__name__} | {f.name: _plain(getattr(self, f.name)) for f in fields(self)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


def _plain(v):
    if isinstance(v, np.ndarray):
        return v.tolist()
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v.to_dict() if isinstance(v, Stored) else v


@dataclass(frozen=True)
class Distribution(Stored):
    """Base: ``inertia`` keeps that share of the old parameters, ``frozen`` keeps them all."""

    inertia: float = field(default=0.0, kw_only=True)
    frozen: bool = field(default=False, kw_only=True)

    def known(self) -> bool:
        """Whether there are parameters."""
        try:
            self.logp_np(np.ones((1, self._width())))
        except (TypeError, AttributeError):
            return False
        return True

    def _width(self) -> int:
        return 1

    def about(self, centre) -> Distribution:
        """The same, summing about a centre as long as there are no parameters, where that saves digits."""
        return self

    def n_terms(self, d: int) -> int:
        """How many terms the log-probability of d columns has, about."""
        return d

    def log_probability(self, df: DataFrame, cols: list[str], out: str = "log_probability") -> DataFrame:
        return df.withColumn(out, self.logp([F.col(c) for c in cols]))

    def probability(self, df: DataFrame, cols: list[str], out: str = "probability") -> DataFrame:
        return df.withColumn(out, F.exp(self.logp([F.col(c) for c in cols])))

    def valid(self, x: Column) -> Column | None:
        """Whether a cell may stand for a value of this distribution; None: any number may."""
        return None

    def n_stats(self, d: int) -> int:
        """How many statistics ``stats`` has for d columns, about."""
        return 3 * d

    def summarize(self, df: DataFrame, cols: list[str], weight=None, check_data: bool = True) -> dict[str, float]:
        """Additive statistics of a DataFrame in one aggregation; weight: a column, a list of one a feature, or nothing.

        Cells outside the support raise ValueError, counted in the same aggregation, unless ``check_data`` is False.
        """
        x, ws = [F.col(c) for c in cols], _weights(weight, len(cols))
        if self.n_stats(len(cols)) > arrow.WIDE:
            s = arrow.summed(df, cols, ws, self.stats_np)
        else:
            exprs = self.stats(x, ws)
            bad = [F.count_if(~v).alias(f"bad_{j}") for j, c in enumerate(x) if check_data and (v := self.valid(c)) is not None]
            if not exprs and not bad:
                return {}
            s = df.agg(*[c.alias(k) for k, c in exprs.items()], *bad).first().asDict()
            if wrong := [cols[int(k[4:])] for k in list(s) if k.startswith("bad_") and s.pop(k)]:
                raise ValueError(f"{', '.join(wrong)}: values outside the support of {type(self).__name__}")
        return s

    def from_summaries(self, *stats: dict[str, float]) -> Distribution:
        """A new distribution from the merged statistics of any number of batches."""
        return self if self.frozen or self.inertia == 1 else self.update(merge(*stats))

    def fit(self, df: DataFrame, cols: list[str], weight=None, check_data: bool = True) -> Distribution:
        return self if self.frozen else self.from_summaries(self.summarize(df, cols, weight, check_data))

    def freeze(self) -> Distribution:
        return replace(self, frozen=True)

    def unfreeze(self) -> Distribution:
        return replace(self, frozen=False)


def from_dict(d: dict):
    """The model that to_dict() described."""
    build = lambda v: from_dict(v) if isinstance(v, dict) and "kind" in v else [build(x) for x in v] if isinstance(v, list) and v and isinstance(v[0], dict) else v
    kind, args = KINDS[d["kind"]], {k: build(v) for k, v in d.items() if k != "kind"}
    return kind.restored(args) if hasattr(kind, "restored") else kind(**args)


def merge(*stats: dict[str, float]) -> dict[str, float]:
    """Statistics of the union of batches; sums about different centres (``at``) are brought to the first one's."""
    out: dict[str, float] = {}
    for s in stats:
        s = _recentred(s, out)
        out |= {k: v for k, v in s.items() if k.startswith("at")}
        s = {k: v for k, v in s.items() if not k.startswith("at")}
        for k, v in s.items():
            if v is None:
                out.setdefault(k, 0.0 if not k.startswith(("min", "max")) else None)
            elif k.startswith("min"):
                out[k] = v if out.get(k) is None else min(out[k], v)
            elif k.startswith("max"):
                out[k] = v if out.get(k) is None else max(out[k], v)
            else:
                out[k] = (out.get(k) or 0.0) + v
    return out


def _recentred(s: dict[str, float], to: dict[str, float]) -> dict[str, float]:
    """Sums of a batch about the centres of another, by what its own centres differ."""
    moved = {k: (s[k] or 0.0) - (to[k] or 0.0) for k in s if k.startswith("at") and k in to and s[k] != to[k]}
    if not moved:
        return s
    out = dict(s)
    for k, d in moved.items():
        name, tag = _split_tag(k)
        j = name[2:]
        get = lambda n, tag=tag: s.get(n + tag) or 0.0
        w = get(f"w{j}") if f"w{j}{tag}" in s else get("w0")
        out[k] = to[k]
        out[f"xw{j}{tag}"] = get(f"xw{j}") + w * d
        if f"xxw{j}{tag}" in s:
            out[f"xxw{j}{tag}"] = get(f"xxw{j}") + 2 * d * get(f"xw{j}") + w * d * d
    for k in s:  # cross products: both ends may have moved
        name, tag = _split_tag(k)
        if name[0] == "c" and "_" in name:
            i, j = name[1:].split("_")
            di, dj = moved.get(f"at{i}{tag}", 0.0), moved.get(f"at{j}{tag}", 0.0)
            get = lambda n, tag=tag: s.get(n + tag) or 0.0
            out[k] = get(name) + dj * get(f"xw{i}") + di * get(f"xw{j}") + get("w0") * di * dj
    return out


def _split_tag(key: str) -> tuple[str, str]:
    name, mark, tag = key.partition("__")
    return name, mark + tag


def _weights(weight, d: int) -> list[Column]:
    if weight is None:
        return [F.lit(1.0)] * d
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return [col(c) for c in weight] if isinstance(weight, (list, tuple)) else [col(weight)] * d


def _moments(cols, ws, *terms) -> dict[str, Column]:
    """Sums of w and of w times each named term, over the cells that are there."""
    out = {}
    for j, (x, w) in enumerate(zip(cols, ws)):
        out[f"w{j}"] = F.sum(F.when(x.isNotNull(), w))
        for name, f in terms:
            out[f"{name}{j}"] = F.sum(w * f(x))
    return out


def _moments_np(X, W, *terms) -> dict[str, float]:
    ok = ~np.isnan(X)
    Z = np.where(ok, X, 1.0)
    out = {}
    for j in range(X.shape[1]):
        w = np.where(ok[:, j], W[:, j], 0.0)
        out[f"w{j}"] = w.sum()
        for name, f in terms:
            out[f"{name}{j}"] = (w * f(Z[:, j])).sum()
    return out


def _vec(s: dict, name: str, d: int) -> np.ndarray:
    return np.array([s.get(f"{name}{j}") or 0.0 for j in range(d)])


def _ratio(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return a / b


@dataclass(frozen=True)
class _Factored(Distribution):
    """Independent features: log-probabilities add up."""

    def _width(self):
        sized = [v for f in fields(self) if isinstance(v := getattr(self, f.name), np.ndarray)]
        return len(sized[0]) if sized else 1

    def logp(self, cols: list[Column]) -> Column:
        return E.total([self.cell(x, j) for j, x in enumerate(cols)])

    def logp_np(self, X: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.isnan(X), 0.0, self.cells_np(X)).sum(1)

    def _terms(self, column: bool):
        return [("xw", lambda x: x)]

    def stats(self, cols, ws):
        return _moments(cols, ws, *self._terms(True))

    def stats_np(self, X, W):
        return _moments_np(X, W, *self._terms(False))


@dataclass(frozen=True)
class Bernoulli(_Factored):
    probs: np.ndarray | None = None

    def __post_init__(self):
        if self.probs is not None:
            object.__setattr__(self, "probs", check("probs", self.probs, 0, 1))

    def valid(self, x):
        return x.isNull() | x.isin(0, 1)

    def cell(self, x, j):
        p = float(self.probs[j])
        own = x * E.lit(safe_log(max(p, EPS))) + (1 - x) * E.lit(safe_log(max(1 - p, EPS)))
        return F.when(self.valid(x), own).otherwise(E.lit(-math.inf))

    def cells_np(self, X):
        return np.where((X == 0) | (X == 1), self._cells(X), -np.inf)

    def _cells(self, X):
        return X * safe_log(np.maximum(self.probs, EPS)) + (1 - X) * safe_log(np.maximum(1 - self.probs, EPS))

    def update(self, s):
        d = _size(s)
        return replace(self, probs=np.clip(blend(self.probs, _ratio(_vec(s, "xw", d), _vec(s, "w", d)), self.inertia), 0, 1))

    def draw(self, rng, n):
        return (rng.random((n, len(self.probs))) < self.probs).astype(float)


def _size(s: dict) -> int:
    return sum(1 for k in s if k.startswith("w") and k[1:].isdigit())


@dataclass(frozen=True)
class Exponential(_Factored):
    """Parameter is the scale, the mean."""

    scales: np.ndarray | None = None

    def __post_init__(self):
        if self.scales is not None:
            object.__setattr__(self, "scales", check("scales", self.scales, 0))

    def valid(self, x):
        return x.isNull() | (x >= 0)

    def cell(self, x, j):
        s = float(self.scales[j])
        if s == 0:  # all mass at zero
            return F.when(x.isNull(), F.lit(None)).when(x == 0, E.lit(math.inf)).otherwise(E.lit(-math.inf))
        return F.when(x < 0, E.lit(-math.inf)).otherwise(E.lit(-math.log(s)) - x / s)

    def cells_np(self, X):
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = np.where(self.scales > 0, -safe_log(self.scales) - X / self.scales, np.where(X == 0, np.inf, -np.inf))
        return np.where(X < 0, -np.inf, inside)

    def update(self, s):
        d = _size(s)
        return replace(self, scales=blend(self.scales, _ratio(_vec(s, "xw", d), _vec(s, "w", d)), self.inertia))

    def draw(self, rng, n):
        return rng.exponential(self.scales, (n, len(self.scales)))


@dataclass(frozen=True)
class Poisson(_Factored):
    lambdas: np.ndarray | None = None

    def __post_init__(self):
        if self.lambdas is not None:
            object.__setattr__(self, "lambdas", check("lambdas", self.lambdas, 0))

    def valid(self, x):
        return x.isNull() | (x >= 0)

    def cell(self, x, j):
        m = float(self.lambdas[j])
        inside = x * E.lit(safe_log(m)) - m - E.lgamma(F.greatest(x, F.lit(0.0)) + 1.0)
        return F.when(x < 0, E.lit(-math.inf)).when(x == 0, E.lit(-m)).otherwise(inside)

    def cells_np(self, X):
        Z = np.where(X > 0, X, 0.0)
        inside = np.where(Z > 0, Z * safe_log(self.lambdas), 0.0) - self.lambdas - lgamma(Z + 1.0)
        return np.where(X < 0, -np.inf, inside)

    def update(self, s):
        d = _size(s)
        return replace(self, lambdas=blend(self.lambdas, _ratio(_vec(s, "xw", d), _vec(s, "w", d)), self.inertia))

    def draw(self, rng, n):
        return rng.poisson(self.lambdas, (n, len(self.lambdas))).astype(float)


@dataclass(frozen=True)
class Gamma(_Factored):
    shapes: np.ndarray | None = None
    rates: np.ndarray | None = None
    tol: float = 1e-8
    max_iter: int = 50

    def __post_init__(self):
        for k in ("shapes", "rates"):
            if getattr(self, k) is not None:
                object.__setattr__(self, k, check(k, getattr(self, k), 0))

    def _terms(self, column):
        log = E.ln if column else np.log
        return [("xw", lambda x: x), ("lw", log)]

    def valid(self, x):
        return x.isNull() | (x >= 0)

    def cell(self, x, j):
        a, b = float(self.shapes[j]), float(self.rates[j])
        power = E.lit(0.0) if a == 1 else (a - 1) * E.ln(x)
        return F.when(x < 0, E.lit(-math.inf)).otherwise(E.lit(a * math.log(b) - lgamma(a)) + power - b * x)

    def cells_np(self, X):
        with np.errstate(divide="ignore", invalid="ignore"):
            power = np.where(self.shapes == 1, 0.0, (self.shapes - 1) * np.log(X))
        return np.where(X < 0, -np.inf, self.shapes * np.log(self.rates) - lgamma(self.shapes) + power - self.rates * X)

    def update(self, s):
        """Shape by Newton steps on ln a - digamma(a) = theta, rate from the mean.

        With a zero among the values theta is infinite and the shape EPS: the likelihood has no maximum, and the solution
        of the equation falls to zero as theta grows.
        """
        d = _size(s)
        w, xw, lw = (_vec(s, k, d) for k in ("w", "xw", "lw"))
        zero = np.isneginf(lw)
        with np.errstate(divide="ignore", invalid="ignore"):
            theta = np.where(zero, 1.0, np.log(_ratio(xw, w)) - _ratio(lw, w))
        a = (3 - theta + np.sqrt((theta - 3) ** 2 + 24 * theta)) / (12 * theta)
        for _ in range(self.max_iter):
            step = (np.log(a) - digamma(a) - theta) / (1 / a - trigamma(a))
            a = np.maximum(a - step, a / 10)
            if (np.abs(step) < self.tol).all():
                break
        a = np.where(zero, EPS, a)
        return replace(self, shapes=blend(self.shapes, a, self.inertia), rates=blend(self.rates, a * _ratio(w, xw), self.inertia))

    def draw(self, rng, n):
        return rng.gamma(self.shapes, 1 / self.rates, (n, len(self.shapes)))


@dataclass(frozen=True)
class Uniform(_Factored):
    """Bounds are the observed extremes; weights do not matter."""

    mins: np.ndarray | None = None
    maxs: np.ndarray | None = None

    def __post_init__(self):
        for k in ("mins", "maxs"):
            if getattr(self, k) is not None:
                object.__setattr__(self, k, check(k, getattr(self, k)))

    def cell(self, x, j):
        a, b = float(self.mins[j]), float(self.maxs[j])
        inside = E.lit(-math.log(b - a) if b > a else math.inf)
        return F.when(x.isNull(), F.lit(None)).when((x >= a) & (x <= b), inside).otherwise(E.lit(-math.inf))

    def cells_np(self, X):
        return np.where((X >= self.mins) & (X <= self.maxs), -np.log(self.maxs - self.mins), -np.inf)

    def stats(self, cols, ws):
        return {f"{f}{j}": getattr(F, f)(x.cast("double")) for j, x in enumerate(cols) for f in ("min", "max")}

    def stats_np(self, X, W):
        return {f"{f}{j}": getattr(np, f"nan{f}")(X[:, j]) for j in range(X.shape[1]) for f in ("min", "max") if (~np.isnan(X[:, j])).any()}

    def update(self, s):
        d = max((int(k[3:]) + 1 for k in s if k.startswith("min")), default=0)
        return replace(self, mins=blend(self.mins, [s[f"min{j}"] for j in range(d)], self.inertia), maxs=blend(self.maxs, [s[f"max{j}"] for j in range(d)], self.inertia))

    def draw(self, rng, n):
        return rng.uniform(self.mins, self.maxs, (n, len(self.mins)))


@dataclass(frozen=True)
class DiracDelta(_Factored):
    """Point mass at zero with log-density ln alpha; nothing is learnt."""

    alphas: np.ndarray | None = None

    def __post_init__(self):
        if self.alphas is not None:
            object.__setattr__(self, "alphas", check("alphas", self.alphas, 0))

    def cell(self, x, j):
        return F.when(x.isNull(), F.lit(None)).when(x == 0, E.lit(safe_log(self.alphas[j]))).otherwise(E.lit(-math.inf))

    def cells_np(self, X):
        return np.where(X == 0, safe_log(self.alphas), -np.inf)

    def stats(self, cols, ws):
        return {}

    def stats_np(self, X, W):
        return {}

    def update(self, s):
        return self


@dataclass(frozen=True)
class Normal(_Factored):
    """Gaussian with full, diag or sphere covariance (``covs`` are (co)variances); variances are floored at ``min_cov``.

    A full covariance needs complete rows: rows with a missing cell are left out of its statistics and score null.
    Sums are about ``origin``, or the old means, or a first pass's averages, so that values far from zero lose no digits.
    """

    means: np.ndarray | None = None
    covs: np.ndarray | None = None
    covariance_type: str = "full"
    min_cov: float = 0.0
    origin: np.ndarray | None = field(default=None, kw_only=True)

    def __post_init__(self):
        if self.covariance_type not in ("full", "diag", "sphere"):
            raise ValueError("covariance_type must be full, diag or sphere")
        for k in ("means", "covs"):
            if getattr(self, k) is not None:
                object.__setattr__(self, k, check(k, getattr(self, k)))
        if self.means is not None and self.covs is not None and self.covariance_type == "sphere":
            object.__setattr__(self, "covs", np.broadcast_to(self.covs, self.means.shape).astype(float))

    def shift(self, x, column: bool):
        return x

    extra = 0.0

    def _width(self):
        return 1 if self.means is None else len(self.means)

    def known(self):
        return self.means is not None and self.covs is not None

    def about(self, centre):
        return self if self.means is not None else replace(self, origin=np.asarray(centre, float))

    def n_terms(self, d):
        return d * (d + 1) // 2 if self.covariance_type == "full" else d

    def centre(self, d: int) -> np.ndarray:
        c = self.origin if self.origin is not None else self.means
        return np.zeros(d) if c is None else np.asarray(c, float)

    def n_stats(self, d):
        return 1 + d + d * (d + 1) // 2 if self.covariance_type == "full" else 3 * d

    def summarize(self, df, cols, weight=None, check_data=True):
        if self.origin is None and self.means is None:
            first = df.agg(*[F.avg(self.shift(F.col(c), True)).alias(f"a{j}") for j, c in enumerate(cols)]).first()
            return replace(self, origin=np.array([v if v is not None and math.isfinite(v) else 0.0 for v in first])).summarize(df, cols, weight, check_data)
        s = super().summarize(df, cols, weight, check_data)
        return s | {f"at{j}": float(c) for j, c in enumerate(self.centre(len(cols)))}

    def cell(self, x, j):
        v, x = float(self.covs[j]), self.shift(x, True)
        return E.lit(-0.5 * math.log(2 * math.pi * v)) - (x - float(self.means[j])) * (x - float(self.means[j])) / (2 * v)

    def cells_np(self, X):
        X = self.shift(X, False)
        return -0.5 * np.log(2 * np.pi * self.covs) - (X - self.means) ** 2 / (2 * self.covs)

    def _whiten(self):
        low = np.linalg.cholesky(self.covs)
        return np.linalg.inv(low), np.log(np.diag(low)).sum()

    def logp(self, cols):
        if self.covariance_type != "full":
            return super().logp(cols) + self.extra
        inv, half = self._whiten()
        d = len(self.means)
        diff = [self.shift(x, True) - float(m) for x, m in zip(cols, self.means)]
        q = None
        for i in range(d):
            r = sum((E.lit(inv[i, j]) * diff[j] for j in range(1, i + 1)), E.lit(inv[i, 0]) * diff[0])
            q = r * r if q is None else q + r * r
        return E.lit(-0.5 * d * math.log(2 * math.pi) - half + self.extra) - q / 2

    def logp_np(self, X):
        if self.covariance_type != "full":
            return super().logp_np(X) + self.extra
        inv, half = self._whiten()
        q = (((self.shift(X, False) - self.means) @ inv.T) ** 2).sum(1)
        return -0.5 * (len(self.means) * np.log(2 * np.pi) + q) - half + self.extra

    def stats(self, cols, ws):
        centre = self.centre(len(cols))
        z = [self.shift(x, True) - float(c) for x, c in zip(cols, centre)]
        if self.covariance_type != "full":
            return _moments(z, ws, ("xw", lambda x: x), ("xxw", lambda x: x * x))
        whole = z[0].isNotNull()
        for x in z[1:]:
            whole = whole & x.isNotNull()
        w = F.when(whole, ws[0])
        out = {"w0": F.sum(w)} | {f"xw{j}": F.sum(w * x) for j, x in enumerate(z)}
        return out | {f"c{i}_{j}": F.sum(w * z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))}

    def stats_np(self, X, W):
        Z = self.shift(X, False) - self.centre(X.shape[1])
        if self.covariance_type != "full":
            return _moments_np(Z, W, ("xw", lambda x: x), ("xxw", lambda x: x * x))
        ok = ~np.isnan(Z).any(1)
        Z, w = Z[ok], W[ok, 0]
        c = (Z * w[:, None]).T @ Z
        return {"w0": w.sum()} | {f"xw{j}": v for j, v in enumerate(w @ Z)} | {f"c{i}_{j}": c[i, j] for i in range(Z.shape[1]) for j in range(i, Z.shape[1])}

    def update(self, s):
        if self.covariance_type == "full":
            d = sum(1 for k in s if k.startswith("xw"))
            w = s.get("w0") or 0.0
            mean = _ratio(_vec(s, "xw", d), w)
            cov = np.array([[_ratio(s[f"c{min(i, j)}_{max(i, j)}"] or 0.0, np.float64(w)) for j in range(d)] for i in range(d)]) - np.outer(mean, mean)
            cov = cov + np.diag(np.maximum(self.min_cov - np.diag(cov), 0))
        else:
            d = _size(s)
            w = _vec(s, "w", d)
            mean = _ratio(_vec(s, "xw", d), w)
            cov = np.maximum(_ratio(_vec(s, "xxw", d), w) - mean**2, self.min_cov)
            if self.covariance_type == "sphere":
                cov = np.full(d, cov.mean())
        own = self.centre(len(mean))
        return replace(self, origin=None)._updated(mean + [s.get(f"at{j}", own[j]) for j in range(len(mean))], cov)

    def _updated(self, mean, cov):
        return replace(self, means=blend(self.means, mean, self.inertia), covs=blend(self.covs, cov, self.inertia))

    def draw(self, rng, n):
        z = rng.standard_normal((n, len(self.means)))
        return self.means + (z @ np.linalg.cholesky(self.covs).T if self.covariance_type == "full" else z * np.sqrt(self.covs))


@dataclass(frozen=True)
class LogNormal(Normal):
    """Gaussian of ln x; ``jacobian`` adds the density's -ln x, without it the score is the density of ln x."""

    covariance_type: str = "diag"
    jacobian: bool = False

    def about(self, centre):
        return self  # logarithms are never large

    def valid(self, x):
        return x.isNull() | (x > 0)

    def shift(self, x, column):
        if column:
            return E.ln(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(x)

    def logp(self, cols):
        out = super().logp(cols)
        return out - E.total([E.ln(x) for x in cols]) if self.jacobian else out

    def logp_np(self, X):
        out = super().logp_np(X)
        return out - np.nansum(np.log(X), 1) if self.jacobian else out

    def draw(self, rng, n):
        return np.exp(super().draw(rng, n))


@dataclass(frozen=True)
class HalfNormal(Normal):
    """Gaussian folded at zero.  Variance is E[x^2] about zero, and ln 2 counts for each dimension; with ``compat`` the variance
    is about the sample mean and ln 2 counts once."""

    covariance_type: str = "diag"
    compat: bool = False

    def __post_init__(self):
        if self.covs is not None and self.means is None:
            object.__setattr__(self, "means", np.zeros(np.asarray(self.covs).shape[0]))
        super().__post_init__()

    @property
    def extra(self):
        if self.compat:
            return math.log(2)
        return math.log(2) * len(self.means) if self.covariance_type == "full" else 0.0

    def cell(self, x, j):
        return super().cell(x, j) + (0.0 if self.compat else math.log(2))

    def cells_np(self, X):
        return super().cells_np(X) + (0.0 if self.compat else math.log(2))

    def valid(self, x):
        return x.isNull() | (x >= 0)

    def logp(self, cols):
        below = F.lit(False)
        for x in cols:
            below = below | F.coalesce(x < 0, F.lit(False))
        return F.when(below, E.lit(-math.inf)).otherwise(super().logp(cols))

    def logp_np(self, X):
        return np.where((X < 0).any(1), -np.inf, super().logp_np(X))

    def _updated(self, mean, cov):
        zero = np.zeros_like(mean)
        if not self.compat:
            cov = cov + (np.outer(mean, mean) if cov.ndim == 2 else mean**2)
        return replace(self, means=zero, covs=blend(self.covs, cov, self.inertia))

    def draw(self, rng, n):
        return np.abs(super().draw(rng, n))


@dataclass(frozen=True)
class StudentT(Normal):
    """Location-scale Student t; ``dofs`` are given, not learnt."""

    dofs: float = 3
    covariance_type: str = "diag"

    def _head(self, v):
        return lgamma((self.dofs + 1) / 2) - lgamma(self.dofs / 2) - 0.5 * np.log(self.dofs * np.pi * v)

    def cell(self, x, j):
        v, z = float(self.covs[j]), x - float(self.means[j])
        return E.lit(self._head(v)) - (self.dofs + 1) / 2.0 * F.log(1 + z * z / (v * self.dofs))

    def cells_np(self, X):
        return self._head(self.covs) - (self.dofs + 1) / 2 * np.log1p((X - self.means) ** 2 / self.covs / self.dofs)

    def draw(self, rng, n):
        return self.means + np.sqrt(self.covs) * rng.standard_t(self.dofs, (n, len(self.means)))


@dataclass(frozen=True)
class Categorical(_Factored):
    """Codes 0..K-1 in each column; ``probs`` is (d, K)."""

    probs: np.ndarray | None = None
    n_categories: int | None = None
    pseudocount: float = 0.0

    def __post_init__(self):
        if self.probs is not None:
            object.__setattr__(self, "probs", check("probs", self.probs, 0, 1, 1))
            object.__setattr__(self, "n_categories", self.probs.shape[1])

    def valid(self, x):
        ok = x.isNull() | ((x >= 0) & (x == F.floor(x)))
        return ok if self.n_categories is None else ok & (x.isNull() | (x < self.n_categories))

    def n_stats(self, d):
        return d * (self.n_categories or 1)

    def cell(self, x, j):
        """Codes beyond the table are impossible: minus infinity."""
        return E.look_up_code(safe_log(self.probs[j]).tolist(), [x], [self.n_categories])

    def cells_np(self, X):
        inside = (X >= 0) & (X < self.n_categories) & (X == np.floor(X))
        i = np.where(inside, X, 0).astype(int)
        return np.where(inside, np.stack([safe_log(self.probs[j])[i[:, j]] for j in range(X.shape[1])], 1), -np.inf)

    def summarize(self, df, cols, weight=None, check_data=True):
        if self.n_categories is None:
            top = df.agg(*[F.max(c) for c in cols]).first()
            return replace(self, n_categories=int(max((v for v in top if v is not None), default=0)) + 1).summarize(df, cols, weight, check_data)
        return super().summarize(df, cols, weight, check_data)

    def stats(self, cols, ws):
        return {f"n{j}_{k}": F.sum(F.when(x == k, w).otherwise(F.when(x.isNotNull(), 0.0))) for j, (x, w) in enumerate(zip(cols, ws)) for k in range(self.n_categories)}

    def stats_np(self, X, W):
        return {f"n{j}_{k}": W[X[:, j] == k, j].sum() for j in range(X.shape[1]) for k in range(self.n_categories)}

    def update(self, s):
        keys = [tuple(map(int, k[1:].split("_"))) for k in s]
        d, K = max(j for j, _ in keys) + 1, max(k for _, k in keys) + 1
        n = np.array([[s[f"n{j}_{k}"] or 0.0 for k in range(K)] for j in range(d)]) + self.pseudocount
        return replace(self, probs=blend(self.probs, n / n.sum(1, keepdims=True), self.inertia))

    def draw(self, rng, n):
        cut = np.cumsum(self.probs, 1)
        return np.stack([np.minimum(np.searchsorted(c, rng.random(n), "right"), len(c) - 1) for c in cut], 1).astype(float)


@dataclass(frozen=True)
class JointCategorical(Distribution):
    """One table over all columns; summarized by a grouped count, so only the combinations that occur are moved.

    Codes outside the table are impossible (minus infinity); rows with a missing cell score null and count for nothing.
    A table of more than ``MOST`` cells raises ValueError instead of filling the driver.
    """

    probs: np.ndarray | None = None
    n_categories: tuple | None = None
    pseudocount: float = 0.0

    MOST = 1 << 24

    def __post_init__(self):
        if self.probs is not None:
            object.__setattr__(self, "probs", check("probs", self.probs, 0, 1))
            if not math.isclose(self.probs.sum(), 1, abs_tol=1e-6):
                raise ValueError("probs must sum to 1")
            object.__setattr__(self, "n_categories", self.probs.shape)

    def _width(self):
        return 1 if self.probs is None else self.probs.ndim

    def valid(self, x):
        return x.isNull() | ((x >= 0) & (x == F.floor(x)))

    def n_stats(self, d):
        return int(np.prod(self.n_categories)) if self.n_categories else 1

    def logp(self, cols):
        return E.look_up_code(safe_log(self.probs).ravel().tolist(), cols, self.n_categories)

    def logp_np(self, X):
        """Rows with a missing cell are NaN."""
        shape = np.array(self.n_categories)
        inside = ((X >= 0) & (X < shape) & (X == np.floor(X))).all(1)
        i = np.where(inside[:, None], X, 0).astype(int)
        out = np.where(inside, safe_log(self.probs)[tuple(i.T)], -np.inf)
        return np.where(np.isnan(X).any(1), np.nan, out)

    def summarize(self, df, cols, weight=None, check_data=True):
        w = _weights(weight, 1)[0]
        whole = df.dropna(subset=cols)
        ok = F.lit(True)
        for j, c in enumerate(cols):
            ok = ok & self.valid(F.col(c))
            if self.n_categories is not None:
                ok = ok & (F.col(c) < self.n_categories[j])
        cells = whole.groupBy(*[F.when(ok, F.col(c).cast("int")).alias(f"k{j}_") for j, c in enumerate(cols)]).agg(F.sum(w).alias("n_"))
        rows = cells.limit(self.MOST + 1).collect()
        if len(rows) > self.MOST:
            raise ValueError(f"more than {self.MOST} combinations")
        out = {}
        for r in rows:
            at = [r[f"k{j}_"] for j in range(len(cols))]
            if None not in at:
                out[_cell(at)] = float(r["n_"] or 0.0)
            elif check_data:
                raise ValueError("codes outside the table")
        return out

    def stats(self, cols, ws):
        """A sum a cell, for use under other weights; needs ``n_categories``."""
        out = {}
        for at in np.ndindex(*self.n_categories):
            here = cols[0] == at[0]
            for x, k in zip(cols[1:], at[1:]):
                here = here & (x == k)
            out[_cell(at)] = F.sum(F.when(here, ws[0]).otherwise(0.0))
        return out

    def stats_np(self, X, W):
        shape = np.array(self.n_categories)
        ok = ((X >= 0) & (X < shape)).all(1)
        table = np.zeros(self.n_categories)
        np.add.at(table, tuple(X[ok].astype(int).T), W[ok, 0])
        return {_cell(at): float(v) for at, v in np.ndenumerate(table)}

    def table(self, s: dict[str, float]) -> np.ndarray:
        """Statistics as an array of counts."""
        at = [tuple(map(int, k[1:].split("_"))) for k in s]
        shape = self.n_categories or tuple(np.max(np.array(at), 0) + 1)
        if np.prod([float(k) for k in shape]) > self.MOST:
            raise ValueError(f"a table of more than {self.MOST} cells")
        out = np.zeros(shape)
        for i, v in zip(at, s.values()):
            out[i] += v or 0.0
        return out

    def counts(self, df: DataFrame, cols: list[str], weight=None) -> np.ndarray:
        return self.table(self.summarize(df, cols, weight))

    def update(self, s):
        n = self.table(s) + self.pseudocount
        return replace(self, probs=blend(self.probs, n / n.sum(), self.inertia))

    def draw(self, rng, n):
        flat = np.minimum(np.searchsorted(np.cumsum(self.probs.ravel()), rng.random(n), "right"), self.probs.size - 1)
        return np.stack(np.unravel_index(flat, self.probs.shape), 1).astype(float)


def _cell(at) -> str:
    return "n" + "_".join(map(str, at))


class ConditionalDistribution:
    """Marks distributions of the last column given those before it; they have no marginal of their own."""

    def marginal(self, dim: int):
        raise NotImplementedError("a conditional distribution has no marginal without its parents'")


@dataclass(frozen=True)
class ConditionalCategorical(JointCategorical, ConditionalDistribution):
    """P(last column | the columns before it); parents that never occur give 1 / K."""

    def __post_init__(self):
        if self.probs is not None:
            object.__setattr__(self, "probs", check("probs", self.probs, 0, 1, 1))
            object.__setattr__(self, "n_categories", self.probs.shape)

    def update(self, s):
        return self.from_counts(self.table(s))

    def from_counts(self, n):
        n = n + self.pseudocount
        p = np.nan_to_num(_ratio(n, n.sum(-1, keepdims=True)), nan=1 / n.shape[-1])
        return replace(self, probs=blend(self.probs, p, self.inertia))

    def draw_given(self, rng, parents):
        p = self.probs[tuple(np.asarray(parents).astype(int).T)]
        return np.minimum((np.cumsum(p, 1) < rng.random((len(p), 1))).sum(1), p.shape[1] - 1).astype(float)


@dataclass(frozen=True)
class ConditionalComponents(Distribution, ConditionalDistribution):
    """A conditional table for each of several features: columns are a list for each, its parents and then itself; scores add up."""

    distributions: list = field(default_factory=list)

    def known(self):
        return all(m.probs is not None for m in self.distributions)

    def log_probability(self, df, cols, out="log_probability"):
        return df.withColumn(out, E.total([m.logp([F.col(c) for c in own]) for m, own in zip(self.distributions, cols)]))

    def probability(self, df, cols, out="probability"):
        return self.log_probability(df, cols, out).withColumn(out, F.exp(out))

    def summarize(self, df, cols, weight=None, check_data=True):
        ws = list(weight) if isinstance(weight, (list, tuple)) else [weight] * len(cols)
        return {_tag(k, f"p{j}"): v for j, m in enumerate(self.distributions) for k, v in m.summarize(df, cols[j], ws[j], check_data).items()}

    def update(self, s):
        return replace(self, distributions=[m.from_summaries(untagged(s, f"p{j}")) for j, m in enumerate(self.distributions)])

    def draw_given(self, rng, parents):
        """A column a feature; ``parents`` is a list of arrays of codes."""
        return np.stack([m.draw_given(rng, p) for m, p in zip(self.distributions, parents)], 1)


@dataclass(frozen=True)
class IndependentComponents(Distribution):
    """One distribution for each column."""

    distributions: list = field(default_factory=list)

    def __post_init__(self):
        if len(self.distributions) < 2:
            raise ValueError("needs two distributions or more")

    def _width(self):
        return len(self.distributions)

    def n_stats(self, d):
        return sum(m.n_stats(1) for m in self.distributions)

    def about(self, centre):
        return replace(self, distributions=[m.about([c]) for m, c in zip(self.distributions, centre)])

    def freeze(self):
        return replace(self, frozen=True, distributions=[m.freeze() for m in self.distributions])

    def unfreeze(self):
        return replace(self, frozen=False, distributions=[m.unfreeze() for m in self.distributions])

    def summarize(self, df, cols, weight=None, check_data=True):
        """Each part's own statistics, so that codes are counted and Gaussians centred as by themselves."""
        ws = list(weight) if isinstance(weight, (list, tuple)) else [weight] * len(cols)
        return {_tag(k, f"p{j}"): v for j, m in enumerate(self.distributions) for k, v in m.summarize(df, [cols[j]], ws[j], check_data).items()}

    def logp(self, cols):
        return E.total([m.logp([x]) for m, x in zip(self.distributions, cols)])

    def logp_np(self, X):
        return sum(m.logp_np(X[:, j : j + 1]) for j, m in enumerate(self.distributions))

    def stats(self, cols, ws):
        return {_tag(k, f"p{j}"): c for j, m in enumerate(self.distributions) for k, c in m.stats([cols[j]], [ws[j]]).items()}

    def stats_np(self, X, W):
        return {_tag(k, f"p{j}"): v for j, m in enumerate(self.distributions) for k, v in m.stats_np(X[:, j : j + 1], W[:, j : j + 1]).items()}

    def update(self, s):
        return replace(self, distributions=[m.from_summaries(untagged(s, f"p{j}")) for j, m in enumerate(self.distributions)])

    def draw(self, rng, n):
        return np.hstack([m.draw(rng, n) for m in self.distributions])


def _tag(key: str, tag: str) -> str:
    return f"{key}__{tag}"  # the statistic's own name stays in front: it says how batches merge


def untagged(s: dict, tag: str) -> dict:
    return {k.removesuffix(f"__{tag}"): v for k, v in s.items() if k.endswith(f"__{tag}")}


tagged = _tag


@dataclass(frozen=True)
class ZeroInflated(Distribution):
    """A distribution mixed with a point mass at zero: priors[j] is the share of column j that is not inflation; fitted by EM."""

    distribution: Distribution | None = None
    priors: np.ndarray | None = None
    max_iter: int = 100
    tol: float = 1e-4

    def _width(self):
        return 1 if self.priors is None else len(self.priors)

    def _parts(self, cols):
        for j, x in enumerate(cols):
            own = self.distribution.cell(x, j) + E.lit(safe_log(self.priors[j]))
            zero = F.when(x == 0, E.lit(safe_log(1 - self.priors[j]))).otherwise(E.lit(-math.inf))
            yield x, [own, zero]

    def logp(self, cols):
        return E.total([F.when(x.isNotNull(), E.log_add(*e)) for x, e in self._parts(cols)])

    def logp_np(self, X):
        with np.errstate(divide="ignore", invalid="ignore"):
            own = self.distribution.cells_np(X) + safe_log(self.priors)
            zero = np.where(X == 0, safe_log(1 - np.asarray(self.priors)), -np.inf)
            both = logsumexp(np.stack([own, zero], 2), 2)
        return np.where(np.isnan(X), 0.0, both).sum(1)

    def stats(self, cols, ws):
        """One expectation step: the child's statistics under the shares that are not inflation, and the priors' sums."""
        r = [1 / (1 + F.exp(zero - own)) for _, (own, zero) in self._parts(cols)]
        r = [F.when(x == 0, y).otherwise(1.0) for x, y in zip(cols, r)]
        out = self.distribution.stats(cols, [w * y for w, y in zip(ws, r)])
        for j, x in enumerate(cols):
            out |= {f"r{j}": F.sum(F.when(x.isNotNull(), ws[j] * r[j])), f"t{j}": F.sum(F.when(x.isNotNull(), ws[j]))}
        return out | {"objective": F.sum(self.logp(cols))}

    def stats_np(self, X, W):
        with np.errstate(divide="ignore", invalid="ignore"):
            own = self.distribution.cells_np(X) + safe_log(self.priors)
            r = np.where(X == 0, 1 / (1 + np.exp(safe_log(1 - np.asarray(self.priors)) - own)), 1.0)
        ok = ~np.isnan(X)
        out = self.distribution.stats_np(X, W * r)
        for j in range(X.shape[1]):
            out |= {f"r{j}": (W * r)[ok[:, j], j].sum(), f"t{j}": W[ok[:, j], j].sum()}
        return out | {"objective": self.logp_np(X).sum()}

    def started(self, df, cols, weight=None) -> ZeroInflated:
        """With a child fitted on everything and even priors, unless there are parameters."""
        if self.priors is not None:
            return self
        return replace(self, distribution=self.distribution.fit(df, cols, weight), priors=np.full(len(cols), 0.5))

    def summarize(self, df, cols, weight=None, check_data=True):
        return self.started(df, cols, weight)._summarize(df, cols, weight, check_data)

    def _summarize(self, df, cols, weight, check_data):
        return super().summarize(df, cols, weight, check_data)

    def update(self, s):
        d = sum(1 for k in s if k[0] == "t" and k[1:].isdigit())
        own = {k: v for k, v in s.items() if k != "objective" and not (k[0] in "rt" and k[1:].isdigit())}
        share = [s[f"r{j}"] / s[f"t{j}"] if s[f"t{j}"] else self.priors[j] for j in range(d)]
        return replace(self, distribution=self.distribution.from_summaries(own), priors=blend(self.priors, share, self.inertia))

    def fit(self, df, cols, weight=None, check_data=True):
        if self.frozen:
            return self
        m, last = self.started(df, cols, weight), None
        for _ in range(m.max_iter):
            s = m._summarize(df, cols, weight, check_data)
            if last is not None and s["objective"] - last < m.tol:
                break
            last, m = s["objective"], m.from_summaries(s)
        return m
