"""Markov chains and hidden Markov models over long tables (seq, t, features...)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.special import logsumexp, safe_log
from ..plans import arrow
from .distributions import ConditionalCategorical, Stored, blend, merge, tagged, untagged
from .mixture import KMeans


@dataclass(frozen=True)
class MarkovChain(Stored):
    """Order-k chain over columns of codes: ``tables[i]`` has i + 1 axes; the last one serves every later window.

    With several columns the tables have one more axis in front, a chain for each, and their scores add up.  Windows come
    from lag() within a sequence, so a sequence is never gathered; counting is a grouped sum of windows.  Codes outside the
    tables are impossible; a window with a missing code counts for nothing.
    """

    k: int | None = None
    tables: list = field(default_factory=list)
    n_categories: int | None = None
    inertia: float = 0.0
    frozen: bool = False

    def __post_init__(self):
        if self.k is None and not self.tables:
            raise ValueError("one of k and tables is needed")
        if self.tables:
            object.__setattr__(self, "tables", [np.asarray(t, float) for t in self.tables])
            object.__setattr__(self, "k", len(self.tables) - 1)
            object.__setattr__(self, "n_categories", self.tables[0].shape[-1])

    def freeze(self):
        return replace(self, frozen=True, **self._fixed())

    def unfreeze(self):
        return replace(self, frozen=False, **self._fixed())

    def _fixed(self) -> dict:
        return {"k": None, "n_categories": None} if self.tables else {}

    @property
    def d(self) -> int:
        return self.tables[0].shape[0] if self.tables[0].ndim > 1 else 1

    def _of(self, j: int) -> list[np.ndarray]:
        return [t[j] for t in self.tables] if self.tables[0].ndim > 1 else self.tables

    def windows(self, df: DataFrame, seq: str, t: str, x) -> DataFrame:
        """Adds x0_0_..xk_0_, the codes from k steps back to now of the first column, and so on, and ``at_``, the position from 0 but k at most."""
        w = Window.partitionBy(seq).orderBy(t)
        at = F.least(F.row_number().over(w) - 1, F.lit(self.k))
        back = [F.lag(F.col(c).cast("int"), self.k - i).over(w).alias(f"x{i}_{j}_") for j, c in enumerate(_listed(x)) for i in range(self.k)]
        return df.select("*", *back, *[F.col(c).cast("int").alias(f"x{self.k}_{j}_") for j, c in enumerate(_listed(x))], at.alias("at_"))

    def log_probability(self, df, seq: str, t: str, x, out="log_probability") -> DataFrame:
        """(seq, log-probability) of each sequence; x is a column or a list of them."""
        total = None
        for j, _ in enumerate(_listed(x)):
            term = None
            for i, table in enumerate(self._of(j)):
                window = [F.col(f"x{self.k - i + a}_{j}_") for a in range(i + 1)]
                v = E.look_up_code(safe_log(table).ravel().tolist(), window, table.shape)
                term = F.when(F.col("at_") == i, v) if term is None else term.when(F.col("at_") == i, v)
            term = F.coalesce(term, E.lit(0))
            total = term if total is None else total + term
        return self.windows(df, seq, t, x).groupBy(seq).agg(F.sum(total).alias(out))

    def probability(self, df, seq, t, x, out="probability") -> DataFrame:
        return self.log_probability(df, seq, t, x, out).withColumn(out, F.exp(out))

    def summarize(self, df, seq, t, x, weight=None) -> dict[str, float]:
        """Additive counts of the windows (column, position, codes), each with its sequence's weight.

        Only windows that occur are moved; more than ``ConditionalCategorical.MOST`` different ones raise ValueError.
        """
        out: dict[str, float] = {}
        rows, most = self.windows(df, seq, t, x), ConditionalCategorical.MOST
        for j, _ in enumerate(_listed(x)):
            keys = [f"x{i}_{j}_" for i in range(self.k + 1)]
            got = rows.groupBy("at_", *keys).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("n_")).limit(most + 1).collect()
            if len(got) > most:
                raise ValueError(f"more than {most} windows")
            for r in got:
                at = [r[f"x{self.k - r['at_'] + a}_{j}_"] for a in range(r["at_"] + 1)]
                if None not in at:
                    if min(at) < 0 or self.n_categories is not None and max(at) >= self.n_categories:
                        raise ValueError("codes outside the tables")
                    out[f"n{j}_" + "_".join(map(str, at))] = float(r["n_"] or 0.0)
        return out

    def from_summaries(self, *stats: dict[str, float]) -> MarkovChain:
        """A new chain from the merged counts of any number of batches."""
        if self.frozen or self.inertia == 1:
            return self
        cells = {tuple(map(int, k[1:].split("_"))): v for k, v in merge(*stats).items()}
        d = max(at[0] for at in cells) + 1
        n = self.n_categories or max(max(at[1:]) for at in cells) + 1
        tables = [np.zeros([d] + [n] * (i + 1)) for i in range(self.k + 1)]
        for at, v in cells.items():
            tables[len(at) - 2][at] += v
        new = [np.stack([ConditionalCategorical().from_counts(c).probs for c in t]) for t in tables]
        if d == 1 and not (self.tables and self.tables[0].ndim > 1):
            new = [t[0] for t in new]
        old = self.tables or [None] * len(new)
        return replace(self, k=None, tables=[blend(o, p, self.inertia) for o, p in zip(old, new)], n_categories=None)

    def fit(self, df, seq, t, x, weight=None) -> MarkovChain:
        return self if self.frozen else self.from_summaries(self.summarize(df, seq, t, x, weight))

    def draw(self, rng, n, length: int | None = None) -> np.ndarray:
        """(n, length) codes, with one more axis for several columns."""
        parts = []
        for c in range(self.d):
            tables = self._of(c)
            out = np.zeros((n, length or self.k + 1), int)
            for j in range(out.shape[1]):
                i = min(j, self.k)
                p = tables[i][tuple(out[:, j - i + a] for a in range(i))] if i else np.tile(tables[0], (n, 1))
                out[:, j] = np.minimum((np.cumsum(p, 1) < rng.random((n, 1))).sum(1), p.shape[1] - 1)
            parts.append(out)
        return parts[0] if self.tables[0].ndim == 1 else np.stack(parts, 2)


def _listed(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# ---- kernels on (n, length, k) arrays of emission log-probabilities ----


class Dense:
    """Transitions as a full table; sums of exponentials are matrix products of scaled probabilities."""

    def __init__(self, edges: np.ndarray):
        self.p, self.log = edges, safe_log(edges)

    def forward_step(self, f):
        m = _finite(f.max(1, keepdims=True))
        with np.errstate(divide="ignore"):
            return np.log(np.exp(f - m) @ self.p) + m

    def backward_step(self, b):
        m = _finite(b.max(1, keepdims=True))
        with np.errstate(divide="ignore"):
            return np.log(np.exp(b - m) @ self.p.T) + m

    def expected(self, f, b, logp, w):
        """Weighted sum over sequences of the expected transitions at one step, from logs to and from there."""
        mf, mb = _finite(f.max(1, keepdims=True)), _finite(b.max(1, keepdims=True))
        scale = w * np.exp(mf[:, 0] + mb[:, 0] - logp)
        return (np.exp(f - mf) * scale[:, None]).T @ np.exp(b - mb) * self.p

    def best_step(self, v):
        """(best predecessor of each state, its score) of each sequence, a slice of states at a time."""
        k = len(self.p)
        at, top = np.empty(v.shape, np.int32), np.empty(v.shape)
        step = max(1, (1 << 22) // max(1, v.size))
        for j in range(0, k, step):
            s = v[:, :, None] + self.log[None, :, j : j + step]
            at[:, j : j + step] = s.argmax(1)
            top[:, j : j + step] = s.max(1)
        return at, top


class Sparse:
    """Transitions as an edge list, sorted by end: a step costs as much as there are edges."""

    def __init__(self, k: int, edges):
        e = sorted({(int(a), int(b)): float(p) for a, b, p in edges}.items(), key=lambda x: (x[0][1], x[0][0]))
        self.k = k
        self.a, self.b = (np.array([x[0][i] for x in e], np.int64) for i in (0, 1))
        self.p = np.array([x[1] for x in e])
        self.log = safe_log(self.p)
        self.ends = np.flatnonzero(np.diff(self.b, prepend=-1))
        self.by_a = np.argsort(self.a, kind="stable")
        self.starts = np.flatnonzero(np.diff(self.a[self.by_a], prepend=-1))

    def _into(self, x, first, of):
        out = np.zeros((len(x), self.k))
        if len(first):
            out[:, of[first]] = np.add.reduceat(x, first, 1)
        return out

    def forward_step(self, f):
        m = _finite(f.max(1, keepdims=True))
        with np.errstate(divide="ignore"):
            return np.log(self._into(np.exp(f - m)[:, self.a] * self.p, self.ends, self.b)) + m

    def backward_step(self, b):
        m = _finite(b.max(1, keepdims=True))
        x = np.exp(b - m)[:, self.b] * self.p
        with np.errstate(divide="ignore"):
            return np.log(self._into(x[:, self.by_a], self.starts, self.a[self.by_a])) + m

    def expected(self, f, b, logp, w):
        mf, mb = _finite(f.max(1, keepdims=True)), _finite(b.max(1, keepdims=True))
        scale = w * np.exp(mf[:, 0] + mb[:, 0] - logp)
        return ((np.exp(f - mf) * scale[:, None])[:, self.a] * np.exp(b - mb)[:, self.b]).sum(0) * self.p

    def best_step(self, v):
        s = v[:, self.a] + self.log
        at, top = np.zeros(v.shape, np.int32), np.full(v.shape, -np.inf)
        for i, j in zip(self.ends, [*self.ends[1:], len(self.b)]):
            best = s[:, i:j].argmax(1)
            at[:, self.b[i]] = self.a[i + best]
            top[:, self.b[i]] = s[np.arange(len(s)), i + best]
        return at, top


def _finite(m):
    return np.where(np.isfinite(m), m, 0.0)


def forward(e, starts, edges):
    f = np.empty_like(e)
    f[:, 0] = starts + e[:, 0]
    for t in range(1, e.shape[1]):
        f[:, t] = edges.forward_step(f[:, t - 1]) + e[:, t]
    return f


def backward(e, ends, edges):
    b = np.empty_like(e)
    b[:, -1] = ends
    for t in range(e.shape[1] - 2, -1, -1):
        b[:, t] = edges.backward_step(b[:, t + 1] + e[:, t + 1])
    return b


def posteriors(e, starts, ends, edges):
    """(forward, backward, log posteriors, log-probabilities) of sequences of one length; impossible ones have no posterior (NaN)."""
    f, b = forward(e, starts, edges), backward(e, ends, edges)
    logp = logsumexp(f[:, -1] + ends, 1)
    with np.errstate(invalid="ignore"):
        r = f + b - logp[:, None, None]
    r[~np.isfinite(logp)] = np.nan
    return f, b, r, logp


def forward_backward(e, starts, ends, edges, w=None):
    """(expected transitions summed over the sequences, log posteriors, start and end posteriors, log-probabilities).

    Weights are a number a sequence; impossible sequences have no part in the sums.
    """
    f, b, r, logp = posteriors(e, starts, ends, edges)
    ok = np.isfinite(logp)
    w = np.where(ok, np.ones(len(e)) if w is None else w, 0.0)[ok]
    t = np.zeros_like(edges.p)
    for i in range(e.shape[1] - 1):
        t += edges.expected(f[ok, i], e[ok, i + 1] + b[ok, i + 1], logp[ok], w)
    with np.errstate(invalid="ignore"):
        return t, r, np.exp(r[:, 0]), np.exp(f[:, -1] + ends - logp[:, None]), logp


def viterbi(e, starts, ends, edges):
    v, back = starts + e[:, 0], []
    for t in range(1, e.shape[1]):
        at, top = edges.best_step(v)
        back.append(at)
        v = top + e[:, t]
    path = [(v + ends).argmax(1)]
    for b in reversed(back):
        path.append(b[np.arange(len(b)), path[-1]])
    return np.stack(path[::-1], 1)


#: Cells of an (n, length, k) array that a kernel holds at a time; a single sequence may have more.
CELLS = 1 << 22


@dataclass(frozen=True)
class DenseHMM(Stored):
    """Hidden Markov model with a full transition matrix.

    Sequences are gathered once by a grouped collect, sorted within; Arrow kernels then work on batches of equal length, of
    CELLS cells at a time.  A fit's round sends each task's partial statistics through one aggregation.  ``prior`` names an
    array column with a weight for each state at each step, as partial or whole labels.
    """

    distributions: list = field(default_factory=list)
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    edges: np.ndarray | None = None
    max_iter: int = 1000
    tol: float = 0.1
    inertia: float = 0.0
    frozen: bool = False

    def __post_init__(self):
        k = len(self.distributions)
        for name, shape in (("starts", (k,)), ("ends", (k,)), ("edges", (k, k))):
            self._checked(name, shape, 1 / max(1, k))

    def _checked(self, name, shape, default):
        v = getattr(self, name)
        v = np.full(shape, default) if v is None else np.asarray(v, float)
        if v.shape != shape or (v < 0).any() or (v > 1).any():
            raise ValueError(f"{name} must be probabilities of shape {shape}")
        object.__setattr__(self, name, v)

    def freeze(self):
        return replace(self, frozen=True, distributions=[m.freeze() for m in self.distributions])

    def unfreeze(self):
        return replace(self, frozen=False, distributions=[m.unfreeze() for m in self.distributions])

    def add_distribution(self, m) -> DenseHMM:
        k = len(self.distributions)
        return replace(self, distributions=[*self.distributions, m], starts=np.append(self.starts, 0.0), ends=np.append(self.ends, 0.0), edges=np.pad(self.edges, (0, 1))) if k else replace(self, distributions=[m], starts=None, ends=None, edges=None)

    def add_distributions(self, ms) -> DenseHMM:
        m = self
        for x in ms:
            m = m.add_distribution(x)
        return m

    def add_edge(self, a: int | None, b: int | None, p: float) -> DenseHMM:
        """A transition; None as its beginning is the start, as its end the end."""
        if not isinstance(p, float):
            raise ValueError("a probability must be a float")
        s, e, t = self.starts.copy(), self.ends.copy(), self.edges.copy()
        if a is None:
            s[b] = p
        elif b is None:
            e[a] = p
        else:
            t[a, b] = p
        return replace(self, starts=s, ends=e, edges=t)

    def add_edges(self, edges) -> DenseHMM:
        m = self
        for x in edges:
            m = m.add_edge(*x)
        return m

    def transitions(self):
        return Dense(self.edges)

    def _logs(self):
        return safe_log(self.starts), safe_log(self.ends), self.transitions()

    @staticmethod
    def gather(df: DataFrame, seq: str, t: str, cols, weight: str | None = None, prior: str | None = None) -> DataFrame:
        """(seq, s, w): one row a sequence, its steps (t, x, p) in order, steps of one time by their values."""
        x = F.array(*[F.col(c).cast("double") for c in cols])
        p = F.array() if prior is None else F.col(prior)
        step = F.struct(F.col(t).alias("t"), x.alias("x"), p.cast("array<double>").alias("p"))
        w = F.first(weight, ignorenulls=True).cast("double") if weight else F.lit(1.0)
        return df.groupBy(seq).agg(F.sort_array(F.collect_list(step)).alias("s"), w.alias("w"))

    def _blocks(self, batch: pa.RecordBatch):
        """(rows, (n, length, d) array, priors (n, length, k) or None) of the sequences of a batch, by length."""
        s = batch.column("s")
        offsets = s.offsets.to_numpy()
        steps = s.values
        xs, ps = steps.field("x"), steps.field("p")
        d = len(xs[int(offsets[0])]) if offsets[-1] > offsets[0] else 1
        flat = xs.values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        po, pv = ps.offsets.to_numpy(), ps.values.to_numpy(zero_copy_only=False)
        k = len(self.distributions)
        lengths = np.diff(offsets)
        xo = xs.offsets.to_numpy()
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            if n == 0:
                continue
            size = max(1, CELLS // int(n * max(k, d)))
            for at in range(0, len(rows), size):
                part = rows[at : at + size]
                step = offsets[part][:, None] + np.arange(n)
                X = flat[xo[step][:, :, None] + np.arange(d)]
                P = pv[po[step][:, :, None] + np.arange(k)] if (np.diff(po) == k).all() and len(pv) else None
                yield part, X, P

    def emissions(self, X, P=None):
        n, length, d = X.shape
        e = np.stack([m.logp_np(X.reshape(-1, d)) for m in self.distributions], 1).reshape(n, length, -1)
        return e if P is None else e + safe_log(P)

    def _map(self, df, seq, t, cols, kernel, kind: str, per_step: bool, out: str, prior=None) -> DataFrame:
        g = self.gather(df, seq, t, cols, prior=prior)
        types, step = dict(g.dtypes), dict(df.dtypes)[t]
        model = self
        value = {"double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}[kind]

        def run(batches):
            for b in batches:
                if not per_step:
                    res = np.full(b.num_rows, np.nan)
                    for at, X, P in model._blocks(b):
                        res[at] = kernel(model.emissions(X, P))
                    yield pa.RecordBatch.from_arrays([b.column(seq), pa.array(res)], [seq, out])
                    continue
                s, res = b.column("s"), [None] * b.num_rows
                for at, X, P in model._blocks(b):
                    for i, v in zip(at, kernel(model.emissions(X, P))):
                        res[i] = v
                offsets = s.offsets.to_numpy()
                times = s.values.field("t").slice(offsets[0], offsets[-1] - offsets[0])
                owner = b.column(seq).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(offsets))))
                flat = np.concatenate([v for v in res if v is not None]) if offsets[-1] > offsets[0] else np.zeros(0)
                got = pa.array(list(flat), value) if flat.ndim > 1 else pa.array(flat, value)
                yield pa.RecordBatch.from_arrays([owner, times, got], [seq, t, out])

        if not per_step:
            return g.select(seq, "s").mapInArrow(run, f"{seq} {types[seq]}, {out} {kind}")
        return g.select(seq, "s").mapInArrow(run, f"{seq} {types[seq]}, {t} {step}, {out} {kind}")

    def log_probability(self, df, seq, t, cols, out="log_probability", prior=None) -> DataFrame:
        s, e, a = self._logs()
        return self._map(df, seq, t, cols, lambda x: logsumexp(forward(x, s, a)[:, -1] + e, 1), "double", False, out, prior)

    def probability(self, df, seq, t, cols, out="probability", prior=None) -> DataFrame:
        return self.log_probability(df, seq, t, cols, out, prior).withColumn(out, F.exp(out))

    def forward(self, df, seq, t, cols, out="forward", prior=None) -> DataFrame:
        s, _, a = self._logs()
        return self._map(df, seq, t, cols, lambda x: forward(x, s, a), "array<double>", True, out, prior)

    def backward(self, df, seq, t, cols, out="backward", prior=None) -> DataFrame:
        _, e, a = self._logs()
        return self._map(df, seq, t, cols, lambda x: backward(x, e, a), "array<double>", True, out, prior)

    def predict_log_proba(self, df, seq, t, cols, out="log_probabilities", prior=None) -> DataFrame:
        """Log posteriors of the states at each step; not a number where the sequence is impossible."""
        s, e, a = self._logs()
        return self._map(df, seq, t, cols, lambda x: posteriors(x, s, e, a)[2], "array<double>", True, out, prior)

    def predict_proba(self, df, seq, t, cols, out="probabilities", prior=None) -> DataFrame:
        s, e, a = self._logs()
        return self._map(df, seq, t, cols, lambda x: np.exp(posteriors(x, s, e, a)[2]), "array<double>", True, out, prior)

    def predict(self, df, seq, t, cols, out="prediction", prior=None) -> DataFrame:
        """Most likely state of each step by its posterior."""
        s, e, a = self._logs()
        return self._map(df, seq, t, cols, lambda x: posteriors(x, s, e, a)[2].argmax(2), "int", True, out, prior)

    def viterbi(self, df, seq, t, cols, out="prediction", prior=None) -> DataFrame:
        """Most likely path."""
        s, e, a = self._logs()
        return self._map(df, seq, t, cols, lambda x: viterbi(x, s, e, a), "int", True, out, prior)

    def forward_backward(self, df, seq, t, cols, weight=None, prior=None) -> tuple[DataFrame, dict[str, float]]:
        """(log posteriors of each step, summed expected transitions, starts and ends as statistics)."""
        return self.predict_log_proba(df, seq, t, cols, prior=prior), self.summarize(df, seq, t, cols, weight, prior)

    def summarize(self, df, seq, t, cols, weight=None, prior=None) -> dict[str, float]:
        """Additive statistics of one expectation step; ``weight`` is a column with one weight a sequence."""
        return self.statistics(self.gather(df, seq, t, cols, weight, prior))

    def statistics(self, gathered: DataFrame) -> dict[str, float]:
        """Summed statistics of one expectation step over gathered sequences; impossible sequences count for nothing."""
        s, e, a = self._logs()
        model = self

        def run(batches):
            out: dict[str, float] = {}

            def add(k, v):
                out[k] = v if k not in out else arrow.combine(k, out[k], v)

            for b in batches:
                weights = b.column("w").to_numpy(zero_copy_only=False).astype(float)
                for at, X, P in model._blocks(b):
                    w = weights[at]
                    tr, r, first, last, logp = forward_backward(model.emissions(X, P), s, e, a, w)
                    ok = np.isfinite(logp)
                    if not ok.any():
                        continue
                    w, X = w[ok], X[ok]
                    add("objective", logp[ok].sum())
                    for name, m in (("t", tr), ("s", (first[ok] * w[:, None]).sum(0)), ("e", (last[ok] * w[:, None]).sum(0))):
                        for i, v in enumerate(m.ravel()):
                            add(f"{name}{i}", v)
                    flat = X.reshape(-1, X.shape[2])
                    share = np.exp(r[ok]) * w[:, None, None]
                    for i, m in enumerate(model.distributions):
                        for k, v in m.stats_np(flat, np.broadcast_to(share[:, :, i].reshape(-1, 1), flat.shape)).items():
                            add(tagged(k, f"c{i}"), v)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([float(v) for v in out.values()], pa.float64())], ["k", "v"])

        return arrow.collected(gathered.select("s", "w").mapInArrow(run, "k string, v double"))

    def from_summaries(self, *stats: dict[str, float]):
        """A new model from the merged statistics of any number of batches."""
        s = merge(*stats)
        if self.frozen or self.inertia == 1 or "objective" not in s:
            return self
        k = len(self.distributions)
        a, e = (np.array([s.get(f"{n}{i}", 0.0) for i in range(k)]) for n in ("s", "e"))
        t = np.array([s.get(f"t{i}", 0.0) for i in range(self.transitions().p.size)])
        out = self._left(t) + e
        safe = np.where(out > 0, out, 1.0)
        new = [m.from_summaries(untagged(s, f"c{i}")) if out[i] > 0 else m for i, m in enumerate(self.distributions)]
        return replace(self, distributions=new, starts=blend(self.starts, a / a.sum(), self.inertia), ends=blend(self.ends, e / safe, self.inertia), **self._moved(t, safe))

    def _left(self, t):
        return t.reshape(self.edges.shape).sum(1)

    def _moved(self, t, out) -> dict:
        return {"edges": blend(self.edges, t.reshape(self.edges.shape) / out[:, None], self.inertia)}

    def initialize(self, df, seq, t, cols, weight=None) -> DenseHMM:
        """Components without parameters are fitted on k-means clusters of all steps, with the sequences' weights."""
        k = len(self.distributions)
        km = KMeans(k=k, max_iter=1).fit(df, cols, weight, order=[seq, t, *cols])
        at = km.predict(df, cols, "cluster_")
        return replace(self, distributions=[m if m.known() else m.fit(at.where(F.col("cluster_") == i), cols, weight) for i, m in enumerate(self.distributions)])

    def ready(self) -> bool:
        return all(m.known() for m in self.distributions)

    def fit(self, df, seq, t, cols, weight=None, prior=None):
        """Baum-Welch; ``weight`` is a column with one weight a sequence."""
        if self.frozen:
            return self
        m = self if self.ready() else self.initialize(df, seq, t, cols, weight)
        g, last = self.gather(df, seq, t, cols, weight, prior).cache(), None
        for _ in range(self.max_iter):
            s = m.statistics(g)
            if "objective" not in s or last is not None and s["objective"] - last < self.tol:
                break
            last, m = s["objective"], m.from_summaries(s)
        g.unpersist()
        return m

    def _next(self) -> np.ndarray:
        full = np.hstack([self.edges, self.ends[:, None]])
        return full / full.sum(1, keepdims=True)

    def draw(self, rng, n, length: int):
        """(paths, steps): n sequences of up to ``length`` steps each, ended early by the end state; -1 after the end."""
        k, full = len(self.distributions), self._next()
        path, out = np.full((n, length), -1), None
        p = np.tile(self.starts / self.starts.sum(), (n, 1))
        live = np.arange(n)
        for j in range(length):
            now = np.minimum((np.cumsum(p, 1) < rng.random((len(live), 1))).sum(1), p.shape[1] - 1)
            go = now < k
            live, now = live[go], now[go]
            if not len(live):
                break
            path[live, j] = now
            for s in range(k):
                x = self.distributions[s].draw(rng, int((now == s).sum()))
                out = np.full((n, length, x.shape[1]), np.nan) if out is None else out
                out[live[now == s], j] = x
            p = full[now]
        return path, out


@dataclass(frozen=True)
class SparseHMM(DenseHMM):
    """Given by an edge list [(from, to, probability)]; what is not listed cannot happen, nor, without ``ends``, can an end.

    Kernels and statistics go by edges; no table of all pairs of states is made.
    """

    edge_list: tuple = ()

    def __post_init__(self):
        k = len(self.distributions)
        if self.edges is not None:
            raise ValueError("a sparse model has an edge_list, no table of edges")
        got = {(int(a), int(b)): float(p) for a, b, p in self.edge_list}
        if not got:
            raise ValueError("needs one edge or more")
        if any(not (0 <= a < k and 0 <= b < k and 0 <= p <= 1) for (a, b), p in got.items()):
            raise ValueError("edges are (state, state, probability)")
        object.__setattr__(self, "edge_list", tuple((a, b, p) for (a, b), p in got.items()))
        self._checked("starts", (k,), 1 / max(1, k))
        self._checked("ends", (k,), 0.0)

    def add_distribution(self, m):
        return replace(self, distributions=[*self.distributions, m], starts=np.append(self.starts, 0.0), ends=np.append(self.ends, 0.0))

    def add_edge(self, a, b, p):
        if not isinstance(p, float):
            raise ValueError("a probability must be a float")
        if a is None or b is None:
            s, e = self.starts.copy(), self.ends.copy()
            (s if a is None else e)[b if a is None else a] = p
            return replace(self, starts=s, ends=e)
        return replace(self, edge_list=(*self.edge_list, (a, b, p)))

    def transitions(self):
        return Sparse(len(self.distributions), self.edge_list)

    def _left(self, t):
        return np.bincount(self.transitions().a, t, len(self.distributions))

    def _moved(self, t, out):
        x = self.transitions()
        new = blend(x.p, t / out[x.a], self.inertia)
        return {"edge_list": tuple(zip(x.a.tolist(), x.b.tolist(), new.tolist()))}

    def _next(self):
        k, x = len(self.distributions), self.transitions()
        full = np.zeros((k, k + 1))
        full[x.a, x.b] = x.p
        full[:, k] = self.ends
        return full / np.maximum(full.sum(1, keepdims=True), 1e-300)
