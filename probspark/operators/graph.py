"""Factor graphs and Bayesian networks over columns of codes."""

from __future__ import annotations

from copy import copy
from itertools import combinations
from math import inf, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.special import safe_log
from ..plans.counts import contingency
from .distributions import Categorical, ConditionalCategorical, Distribution, JointCategorical, Stored, blend, from_dict, merge


def _cells(tables: dict) -> dict[str, float]:
    """Count tables as additive statistics ``n<table>_<codes>``; empty cells are left out."""
    return {f"n{i}_" + "_".join(map(str, at)): float(v) for i, t in tables.items() for at, v in np.ndenumerate(t) if v}


def _tables(stats, shapes: list[tuple]) -> list[np.ndarray]:
    out = [np.zeros(s) for s in shapes]
    for k, v in merge(*stats).items():
        i, *at = map(int, k[1:].split("_"))
        out[i][tuple(at)] += v or 0.0
    return out


class FactorGraph(Stored):
    """Factors (tables) over marginals (one a column); a factor's axes follow the order in which its edges are added.

    Fitting gives a new graph.
    """

    def __init__(self, max_iter: int = 20, tol: float = 1e-6):
        self.factors: list = []
        self.marginals: list[Categorical] = []
        self.edges: list[list[int]] = []
        self.max_iter, self.tol = max_iter, tol

    def add_factor(self, factor) -> int:
        if not isinstance(factor, (Categorical, JointCategorical)):
            raise ValueError("factors are Categorical or JointCategorical")
        self.factors.append(factor)
        self.edges.append([])
        return len(self.factors) - 1

    def add_marginal(self, marginal: Categorical) -> int:
        if not isinstance(marginal, Categorical):
            raise ValueError("marginals are Categorical")
        self.marginals.append(marginal)
        return len(self.marginals) - 1

    def add_edge(self, marginal: int, factor: int) -> None:
        if not 0 <= marginal < len(self.marginals) or not 0 <= factor < len(self.factors):
            raise ValueError("no such marginal or factor")
        self.edges[factor].append(marginal)

    def to_dict(self) -> dict:
        return {"kind": "FactorGraph", "factors": [f.to_dict() for f in self.factors], "marginals": [m.to_dict() for m in self.marginals], "edges": self.edges, "max_iter": self.max_iter, "tol": self.tol}

    @classmethod
    def restored(cls, d: dict) -> FactorGraph:
        g = cls(d["max_iter"], d["tol"])
        g.factors, g.marginals, g.edges = list(d["factors"]), list(d["marginals"]), [list(e) for e in d["edges"]]
        return g

    def _tables(self):
        return [f.probs[0] if isinstance(f, Categorical) else f.probs for f in self.factors]

    def logp(self, cols):
        terms = [m.logp([c]) for m, c in zip(self.marginals, cols)]
        for t, e in zip(self._tables(), self.edges):
            terms.append(E.look_up_code(safe_log(t).ravel().tolist(), [cols[j] for j in e], t.shape))
        return sum(terms[1:], terms[0])

    def log_probability(self, df: DataFrame, cols, out="log_probability") -> DataFrame:
        """Null where a code is missing, minus infinity where one is in no table."""
        return df.withColumn(out, self.logp([F.col(c) for c in cols]))

    def probability(self, df: DataFrame, cols, out="probability") -> DataFrame:
        return df.withColumn(out, F.exp(self.logp([F.col(c) for c in cols])))

    def beliefs(self, X: np.ndarray) -> list[np.ndarray]:
        """Loopy belief propagation for rows of codes with NaN where unknown; one row's stopping does not depend on the others."""
        n, tables = len(X), self._tables()
        cards = [m.probs.shape[1] for m in self.marginals]
        start = []
        for j, m in enumerate(self.marginals):
            b = np.tile(m.probs[0], (n, 1))
            seen = ~np.isnan(X[:, j])
            b[seen] = np.eye(cards[j])[X[seen, j].astype(int)]
            start.append(b)
        to_factor = {(f, a): start[j] for f, e in enumerate(self.edges) for a, j in enumerate(e)}
        belief, live = [b.copy() for b in start], np.ones(n, bool)
        for _ in range(self.max_iter):
            to_marginal = {}
            for f, e in enumerate(self.edges):
                for a in range(len(e)):
                    x = np.broadcast_to(tables[f], (n, *tables[f].shape))
                    for b in range(len(e)):
                        if b != a:
                            shape = [n] + [1] * len(e)
                            shape[b + 1] = -1
                            x = x * to_factor[f, b].reshape(shape)
                    x = x.sum(tuple(b + 1 for b in range(len(e)) if b != a))
                    to_marginal[f, a] = x / np.maximum(x.sum(1, keepdims=True), 1e-300)
            gone = np.zeros(n)
            for j in range(len(cards)):
                x = start[j].copy()
                for (f, a), msg in to_marginal.items():
                    if self.edges[f][a] == j:
                        x = x * msg
                x /= np.maximum(x.sum(1, keepdims=True), 1e-300)
                gone += (belief[j] * (np.log(belief[j] + 1e-8) - np.log(x + 1e-8))).sum(1)
                belief[j] = np.where(live[:, None], x, belief[j])
            live &= np.abs(gone) >= self.tol
            if not live.any():
                break
            for f, e in enumerate(self.edges):
                for a, j in enumerate(e):
                    x = start[j].copy()
                    for (g, b), msg in to_marginal.items():
                        if self.edges[g][b] == j and (g, b) != (f, a):
                            x = x * msg
                    to_factor[f, a] = x / np.maximum(x.sum(1, keepdims=True), 1e-300)
        return belief

    def predict_proba(self, df: DataFrame, cols, out="probabilities") -> DataFrame:
        """Array of each column's posterior; null cells are the unknowns.

        Inference runs once for each pattern of evidence, and the rows get it by a null-safe join.
        """
        beliefs, names = self.beliefs, [f"c{j}_" for j in range(len(cols))]

        def run(batches):
            for b in batches:
                x = b[names].to_numpy(float)
                p = beliefs(x)
                yield b.assign(**{out: [[q[i].tolist() for q in p] for i in range(len(b))]})

        patterns = df.select(*[F.col(c).cast("int").alias(n) for c, n in zip(cols, names)]).distinct()
        done = patterns.mapInPandas(run, ", ".join(f"{n} int" for n in names) + f", {out} array<array<double>>")
        on = [F.col(c).cast("int").eqNullSafe(F.col(n)) for c, n in zip(cols, names)]
        return df.join(done, on, "left").drop(*names)

    def predict_log_proba(self, df, cols, out="log_probabilities") -> DataFrame:
        return self.predict_proba(df, cols, out).withColumn(out, F.transform(out, lambda p: F.transform(p, E.ln)))

    def predict(self, df, cols, out="prediction") -> DataFrame:
        return self.predict_proba(df, cols, out).withColumn(out, F.transform(out, E.argmax))

    def summarize(self, df: DataFrame, cols, weight=None) -> dict[str, float]:
        """Additive counts of the factors' cells, all in one scan."""
        cards = {c: m.probs.shape[1] for c, m in zip(cols, self.marginals)}
        sets = [tuple(cols[j] for j in e) for e in self.edges]
        n = contingency(df, list(dict.fromkeys(sets)), cards, F.col(weight) if weight else None)
        return _cells({i: n[s] for i, s in enumerate(sets)})

    def from_summaries(self, *stats: dict[str, float]) -> FactorGraph:
        """Factors by the merged counts of any number of batches; marginals and factors without a count stay."""
        out = copy(self)
        out.factors = list(self.factors)
        for i, n in enumerate(_tables(stats, [t.shape for t in self._tables()])):
            f = self.factors[i]
            if n.sum() and not f.frozen:
                p = n / n.sum()
                out.factors[i] = type(f)(probs=blend(f.probs, p[None] if isinstance(f, Categorical) else p, f.inertia), inertia=f.inertia)
        return out

    def fit(self, df: DataFrame, cols, weight=None) -> FactorGraph:
        return self.from_summaries(self.summarize(df, cols, weight))

    def freeze(self) -> FactorGraph:
        out = copy(self)
        out.factors = [f.freeze() for f in self.factors]
        return out

    def unfreeze(self) -> FactorGraph:
        out = copy(self)
        out.factors = [f.unfreeze() for f in self.factors]
        return out


class BayesianNetwork(Stored):
    """Directed tables: a Categorical for each root, a ConditionalCategorical (child on the last axis) for the others.

    Built from a structure, learnt by fit(), or put together by add_distribution() and add_edge(), parents in the order of
    their edges.  Fitting gives a new network.
    """

    def __init__(self, structure: tuple | None = None, algorithm: str | None = None, max_parents: int | None = None, exclude_parents=None, include_parents=None, pseudocount: float = 0.0, inertia: float = 0.0, root: int = 0, compat: bool = False, max_iter: int = 20, tol: float = 1e-6):
        if algorithm not in (None, "chow-liu", "exact"):
            raise ValueError("algorithm must be chow-liu or exact")
        self.structure, self.algorithm, self.max_parents, self.root = structure, algorithm, max_parents, root
        self.exclude, self.include = exclude_parents, include_parents
        self.pseudocount, self.inertia, self.compat, self.max_iter, self.tol = pseudocount, inertia, compat, max_iter, tol
        self.tables: list[np.ndarray] = []
        self.frozen = False

    def to_dict(self) -> dict:
        own = {k: getattr(self, k) for k in ("algorithm", "max_parents", "pseudocount", "inertia", "root", "compat", "max_iter", "tol")}
        listed = lambda x: None if x is None else [list(v) for v in x]
        return {"kind": "BayesianNetwork", "structure": listed(self.structure), "exclude_parents": listed(self.exclude), "include_parents": listed(self.include), "tables": [t.tolist() for t in self.tables]} | own

    @classmethod
    def restored(cls, d: dict) -> BayesianNetwork:
        tables = d.pop("tables")
        structure = d.pop("structure")
        m = cls(None if structure is None else tuple(map(tuple, structure)), **d)
        m.tables = [np.asarray(t, float) for t in tables]
        return m

    def add_distribution(self, m: Distribution) -> int:
        """The number of a new node; its parents come with add_edge()."""
        if isinstance(m, ConditionalCategorical):
            table = m.probs
        elif isinstance(m, Categorical):
            table = m.probs[0]
        else:
            raise ValueError("nodes are Categorical or ConditionalCategorical")
        self.tables.append(np.asarray(table, float))
        self.structure = (*(self.structure or ()), ())
        return len(self.tables) - 1

    def add_distributions(self, ms) -> list[int]:
        return [self.add_distribution(m) for m in ms]

    def add_edge(self, parent: int, child: int) -> None:
        """A parent more of a node, on the next axis of its table."""
        n = len(self.tables)
        if not (0 <= parent < n and 0 <= child < n):
            raise ValueError("no such node")
        if parent == child:
            raise ValueError("a node cannot be its own parent")
        ps = self.structure[child]
        if parent in ps or len(ps) + 1 >= self.tables[child].ndim:
            raise ValueError("the child's table has no axis for this parent")
        if self.tables[child].shape[len(ps)] != self.tables[parent].shape[-1]:
            raise ValueError("the child's table does not fit the parent's categories")
        now = (*self.structure[:child], (*ps, parent), *self.structure[child + 1 :])
        before, self.structure = self.structure, now
        try:
            self.order()
        except ValueError:
            self.structure = before
            raise

    def add_edges(self, edges) -> None:
        for parent, child in edges:
            self.add_edge(parent, child)

    def freeze(self) -> BayesianNetwork:
        out = copy(self)
        out.frozen = True
        return out

    def unfreeze(self) -> BayesianNetwork:
        out = copy(self)
        out.frozen = False
        return out

    @classmethod
    def from_tables(cls, structure, tables, **kw) -> BayesianNetwork:
        m = cls(structure, **kw)
        m.tables = [np.asarray(t, float) for t in tables]
        return m

    @staticmethod
    def cards(df: DataFrame, cols) -> dict[str, int]:
        top = df.agg(*[F.max(c).alias(c) for c in cols]).first()
        return {c: int(top[c]) + 1 for c in cols}

    def learnt(self, df: DataFrame, cols, weight=None) -> BayesianNetwork:
        """With a structure: its own, or the one its algorithm finds."""
        if self.structure is not None:
            return self
        cards, w = self.cards(df, cols), F.col(weight) if weight else None
        out = copy(self)
        out.structure = learn_structure(df, cols, cards, self.algorithm or "chow-liu", w, self.max_parents, self.exclude, self.include, self.pseudocount, self.root, self.compat)
        return out

    def summarize(self, df: DataFrame, cols, weight=None) -> dict[str, float]:
        """Additive counts of each node with its parents, all in one scan; needs a structure."""
        if self.structure is None:
            raise ValueError("learn a structure first")
        cards = {c: t.shape[-1] for c, t in zip(cols, self.tables)} if self.tables else self.cards(df, cols)
        sets = [(*[cols[p] for p in ps], cols[i]) for i, ps in enumerate(self.structure)]
        n = contingency(df, list(dict.fromkeys(sets)), cards, F.col(weight) if weight else None)
        # a last cell of weight 0 keeps the widths of tables that a batch does not fill
        out = _cells({i: n[s] for i, s in enumerate(sets)})
        return out | {k: out.get(k, 0.0) for k in (f"n{i}_" + "_".join(str(v - 1) for v in n[s].shape) for i, s in enumerate(sets))}

    def from_summaries(self, *stats: dict[str, float]) -> BayesianNetwork:
        """Tables by the merged counts of any number of batches; parents that never occur give even odds."""
        if self.frozen or self.inertia == 1:
            return self
        if self.tables:
            shapes = [t.shape for t in self.tables]
        else:
            cards = [0] * len(self.structure)
            for k in merge(*stats):
                i, *at = map(int, k[1:].split("_"))
                for j, v in zip((*self.structure[i], i), at):
                    cards[j] = max(cards[j], v + 1)
            shapes = [tuple(cards[j] for j in (*ps, i)) for i, ps in enumerate(self.structure)]
        new = [ConditionalCategorical().from_counts(n + self.pseudocount).probs for n in _tables(stats, shapes)]
        out = copy(self)
        out.tables = [blend(o, p, self.inertia) for o, p in zip(self.tables, new)] if self.tables else new
        return out

    def fit(self, df: DataFrame, cols, weight=None) -> BayesianNetwork:
        if self.frozen:
            return self
        m = self.learnt(df, cols, weight)
        return m.from_summaries(m.summarize(df, cols, weight))

    def logp(self, cols):
        terms = [E.look_up_code(safe_log(t).ravel().tolist(), [cols[j] for j in (*ps, i)], t.shape) for i, (ps, t) in enumerate(zip(self.structure, self.tables))]
        return sum(terms[1:], terms[0])

    def log_probability(self, df, cols, out="log_probability") -> DataFrame:
        """Null where a code is missing, minus infinity where one is in no table."""
        return df.withColumn(out, self.logp([F.col(c) for c in cols]))

    def probability(self, df, cols, out="probability") -> DataFrame:
        return df.withColumn(out, F.exp(self.logp([F.col(c) for c in cols])))

    def graph(self) -> FactorGraph:
        """The same network as a factor graph: uniform marginals and a table for each node and its parents."""
        g = FactorGraph(self.max_iter, self.tol)
        for t in self.tables:
            g.add_marginal(Categorical(probs=np.full((1, t.shape[-1]), 1 / t.shape[-1])))
        for i, (ps, t) in enumerate(zip(self.structure, self.tables)):
            joint = t / t.sum()
            f = g.add_factor(Categorical(probs=joint[None]) if not ps else JointCategorical(probs=joint))
            for j in (*ps, i):
                g.add_edge(j, f)
        return g

    def predict_proba(self, df, cols, out="probabilities") -> DataFrame:
        return self.graph().predict_proba(df, cols, out)

    def predict_log_proba(self, df, cols, out="log_probabilities") -> DataFrame:
        return self.graph().predict_log_proba(df, cols, out)

    def predict(self, df, cols, out="prediction") -> DataFrame:
        return self.graph().predict(df, cols, out)

    def order(self) -> list[int]:
        done: list[int] = []
        while len(done) < len(self.structure):
            ready = [i for i, ps in enumerate(self.structure) if i not in done and set(ps) <= set(done)]
            if not ready:
                raise ValueError("the structure has a cycle")
            done += ready
        return done

    def draw(self, rng, n):
        x = np.zeros((n, len(self.tables)))
        for i in self.order():
            ps = self.structure[i]
            p = self.tables[i][tuple(x[:, j].astype(int) for j in ps)] if ps else np.tile(self.tables[i], (n, 1))
            x[:, i] = np.minimum((np.cumsum(p, 1) < rng.random((n, 1))).sum(1), p.shape[1] - 1)
        return x


def _xlogy(n, ratio, compat):
    with np.errstate(divide="ignore", invalid="ignore"):
        x = n * np.log(ratio)
    return x if compat else np.where(n > 0, x, 0.0)


def mutual_information(df: DataFrame, cols, cards, weight=None, pseudocount: float = 0.0, compat: bool = False) -> np.ndarray:
    """Negative pairwise mutual information, in weight units; all pairs in one scan."""
    if compat:  # tables as wide as the widest column, whose empty cells then are not numbers
        cards = dict.fromkeys(cols, max(cards[c] for c in cols))
    sets = [(c,) for c in cols] + list(combinations(cols, 2))
    n = contingency(df, sets, cards, weight)
    total = n[(cols[0],)].sum()
    out = np.zeros((len(cols), len(cols)))
    for i, j in combinations(range(len(cols)), 2):
        joint = n[cols[i], cols[j]] + pseudocount
        m = np.outer(n[(cols[i],)], n[(cols[j],)]) / total
        with np.errstate(divide="ignore", invalid="ignore"):
            out[i, j] = out[j, i] = -_xlogy(joint, joint / m, compat).sum()
    return out


def learn_structure(df, cols, cards, algorithm="chow-liu", weight=None, max_parents=None, exclude=None, include=None, pseudocount=0.0, root=0, compat=False):
    if algorithm == "chow-liu":
        return chow_liu(mutual_information(df, cols, cards, weight, pseudocount, compat), root)
    if algorithm == "exact":
        return exact(df, cols, cards, weight, max_parents, exclude, include, pseudocount, compat)
    raise ValueError("algorithm must be chow-liu or exact")


def chow_liu(scores: np.ndarray, root: int = 0) -> tuple:
    """Smallest spanning tree from the root; a score that is not a number is the smallest, first one first."""
    d = len(scores)
    s = np.where(np.isnan(scores), -inf, scores)
    parents: list[tuple] = [() for _ in range(d)]
    near, best = np.full(d, root), s[root].copy()
    left = set(range(d)) - {root}
    while left:
        i = min(sorted(left), key=lambda j: best[j])
        parents[i] = (int(near[i]),)
        left.remove(i)
        for j in left:
            if s[i, j] < best[j]:
                best[j], near[j] = s[i, j], i
    return tuple(parents)


#: Columns that the exact search takes at most: its programme has 2^d states.
MOST_COLUMNS = 16


def exact(df, cols, cards, weight=None, max_parents=None, exclude=None, include=None, pseudocount=0.0, compat=False) -> tuple:
    """Best-scoring network: family scores from one scan of counts, then a programme over subsets of columns.

    Empty cells count 0 ln 0 = 0.  With ``compat`` tables are as wide as the widest column, empty cells make a score that is
    not a number, such a score is never beaten, and a family of that score costs nothing.
    """
    d = len(cols)
    if d > MOST_COLUMNS:
        raise ValueError(f"the exact search takes {MOST_COLUMNS} columns at most")
    total = float(df.agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("w")).first()["w"] or 0.0)
    if max_parents is None:
        max_parents = int(log2(2 * total / log2(total))) if total > 2 else 1
    most = min(max_parents, d - 1)
    wide = dict.fromkeys(cols, max(cards[c] for c in cols)) if compat else cards
    sets = [s for k in range(1, most + 2) for s in combinations(cols, k)]
    n = contingency(df, sets, wide, weight)

    def score(i, ps):
        s = tuple(c for k, c in enumerate(cols) if k == i or k in ps)
        c = n[s] + pseudocount
        parent = c.sum(s.index(cols[i]), keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = c * np.log2(c / parent)
        ll = x.sum() if compat else np.where(c > 0, x, 0.0).sum()
        size = float(np.prod([cards[cols[k]] for k in ps])) * (cards[cols[i]] - 1)
        return ll - 0.5 * log2(max(total, 1.0)) * size

    must = [set(include[i]) if include else set() for i in range(d)]
    ban = [set(exclude[i]) if exclude else set() for i in range(d)]
    family = [{ps: score(i, ps) for k in range(most + 1) for ps in combinations([j for j in range(d) if j != i], k) if must[i] <= set(ps) and not ban[i] & set(ps)} for i in range(d)]
    choice: list[dict[int, tuple]] = [{} for _ in range(d)]

    def within(i, mask):
        """(score, parents) of the best family of a node among the columns of a mask: all of them, or the best without one."""
        if mask not in choice[i]:
            whole = tuple(j for j in range(d) if mask >> j & 1)
            got = (family[i].get(whole, -inf), whole if whole in family[i] else ())
            for j in whole:
                fewer = within(i, mask ^ (1 << j))
                # without compat, of equal scores the smaller family
                if fewer[0] > got[0] or not compat and fewer[0] > got[0] - 1e-12 and len(fewer[1]) < len(got[1]):
                    got = fewer
            choice[i][mask] = got
        return choice[i][mask]

    # from each set of placed columns the least cost of placing the rest, so that ties go to the column that comes first
    full = (1 << d) - 1
    cost = {full: 0.0}
    for mask in range(full - 1, -1, -1):
        cost[mask] = min((0.0 if np.isnan(v := within(i, mask)[0]) else -v) + cost[mask | 1 << i] for i in range(d) if not mask >> i & 1)
    out: list[tuple] = [() for _ in range(d)]
    mask = 0
    while mask != full:
        for i in range(d):
            if not mask >> i & 1:
                v, ps = within(i, mask)
                if (0.0 if np.isnan(v) else -v) + cost[mask | 1 << i] <= cost[mask] + 1e-9:
                    out[i], mask = ps, mask | 1 << i
                    break
    return tuple(out)
