"""Closed forms, invariants and brute-force comparisons for the core models, on data of our own."""

import itertools
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from probspark.functions import exprs as E
from probspark.functions.special import digamma, lgamma, trigamma
from probspark.operators import distributions as D
from probspark.operators.graph import BayesianNetwork, FactorGraph, chow_liu, exact, mutual_information
from probspark.operators.mixture import BayesClassifier, GeneralMixtureModel, KMeans
from probspark.operators.sequence import DenseHMM, MarkovChain, SparseHMM
from probspark.plans import arrow, counts
from probspark.sources.samples import sample, sample_sequences
from probspark.streaming.incremental import Incremental

RNG = np.random.default_rng(17)
X = RNG.poisson(2.0, (40, 3)).astype(float)
W = RNG.integers(0, 4, 40).astype(float)
Y = (X[:, 0] > 2).astype(int)
Z = RNG.gamma(2.5, 1.3, (40, 3))
C = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *map(float, x), float(w), int(y)) for i, (x, w, y) in enumerate(zip(X, W, Y))], "id long, x1 double, x2 double, x3 double, w double, y int").cache()


@pytest.fixture(scope="module")
def reals(spark):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(Z)], "id long, x1 double, x2 double, x3 double").cache()


def column(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


# ---- distributions ----

NO = -math.inf
POINTS = [
    (D.Exponential(scales=[1.6]), [0.5, 3.0, 0.0, -1.0], lambda x: -math.log(1.6) - x / 1.6 if x >= 0 else NO),
    (D.Gamma(shapes=[1.9], rates=[0.7]), [0.5, 3.0, 7.25, -1.0], lambda x: 1.9 * math.log(0.7) - math.lgamma(1.9) + 0.9 * math.log(x) - 0.7 * x if x > 0 else NO),
    (D.Normal(means=[0.4], covs=[2.2], covariance_type="diag"), [0.5, -3.0, 7.0], lambda x: -0.5 * math.log(2 * math.pi * 2.2) - (x - 0.4) ** 2 / 4.4),
    (D.Normal(means=[0.4], covs=[[2.2]]), [0.5, -3.0, 7.0], lambda x: -0.5 * math.log(2 * math.pi * 2.2) - (x - 0.4) ** 2 / 4.4),
    (D.HalfNormal(covs=[2.2]), [0.5, 3.0, -1.0], lambda x: math.log(2) - 0.5 * math.log(2 * math.pi * 2.2) - x * x / 4.4 if x >= 0 else NO),
    (D.LogNormal(means=[0.4], covs=[2.2]), [0.5, 3.0], lambda x: -0.5 * math.log(2 * math.pi * 2.2) - (math.log(x) - 0.4) ** 2 / 4.4),
    (D.StudentT(dofs=4, means=[0.4], covs=[2.2]), [0.5, -3.0, 7.0], lambda x: math.lgamma(2.5) - math.lgamma(2) - 0.5 * math.log(4 * math.pi * 2.2) - 2.5 * math.log(1 + (x - 0.4) ** 2 / 8.8)),
    (D.Poisson(lambdas=[2.3]), [0.0, 1.0, 9.0, -1.0], lambda x: x * math.log(2.3) - 2.3 - math.lgamma(x + 1) if x >= 0 else NO),
    (D.Poisson(lambdas=[0.0]), [0.0, 1.0, -1.0], lambda x: 0.0 if x == 0 else NO),
    (D.Bernoulli(probs=[0.35]), [1.0, 0.0, 0.5, 2.0], lambda x: math.log(0.35) if x == 1 else math.log(0.65) if x == 0 else NO),
    (D.Uniform(mins=[1.5], maxs=[3.5]), [1.5, 2.0, 3.6], lambda x: -math.log(2) if 1.5 <= x <= 3.5 else NO),
    (D.DiracDelta(alphas=[0.25]), [0.0, 1.0], lambda x: math.log(0.25) if x == 0 else NO),
    (D.Categorical(probs=[[0.2, 0.8]]), [1.0, 0.0, 2.0, -1.0], lambda x: math.log([0.2, 0.8][int(x)]) if x in (0, 1) else NO),
    (D.ZeroInflated(distribution=D.Poisson(lambdas=[2.3]), priors=np.array([0.7])), [0.0, 3.0], lambda x: math.log(0.7 * math.exp(-2.3) + 0.3) if x == 0 else math.log(0.7) + x * math.log(2.3) - 2.3 - math.lgamma(x + 1)),
]


@pytest.mark.parametrize("m,x,f", POINTS, ids=lambda v: type(v).__name__ if isinstance(v, D.Distribution) else "")
def test_point_scores(spark, m, x, f):
    want = [f(v) for v in x]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(99, None)], "id long, x double")
    got = column(m.log_probability(df, ["x"], "lp"), "lp")
    assert np.allclose(got[:-1], want, atol=1e-9)
    assert got[-1] in (0.0, None)  # a missing cell counts nothing
    assert np.allclose(column(m.probability(df, ["x"], "p"), "p")[:-1], np.exp(want))
    again = D.from_dict(json.loads(m.to_json()))
    for model in (m, again):
        assert np.allclose(model.logp_np(np.array(x, float)[:, None]), want, atol=1e-9)


def test_special_functions(spark):
    x = np.array([0.1, 1.0, 2.5, 7.0, 150.0])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x])
    h = 1e-4
    assert np.allclose(digamma(x[1:]), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x[1:]], atol=1e-5)
    assert np.allclose(trigamma(x[1:]), (digamma(x[1:] + h) - digamma(x[1:] - h)) / (2 * h), atol=1e-5)
    rows = [([1.0, 2.0, -900.0],), ([NO, NO],), ([NO, 0.5],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>").select(E.logsumexp(F.col("a"))).collect()]
    assert np.allclose(got[:3], [math.log(math.e + math.e**2), NO, 0.5]) and got[3] is None


def test_fits(reals):
    n = D.Normal(covariance_type="diag").fit(reals, C)
    assert np.allclose(n.means, Z.mean(0)) and np.allclose(n.covs, Z.var(0))
    u = D.Uniform().fit(reals, C)
    assert np.allclose(u.mins, Z.min(0)) and np.allclose(u.maxs, Z.max(0))
    g = D.Gamma().fit(reals, C)  # the likelihood's slopes vanish
    assert np.allclose(g.shapes / g.rates, Z.mean(0)) and np.allclose(digamma(g.shapes) - np.log(g.rates), np.log(Z).mean(0), atol=1e-6)
    assert np.allclose(D.Normal().fit(reals, C).covs, np.cov(Z.T, bias=True))
    h = D.HalfNormal().fit(reals, C)
    assert np.allclose(h.covs, (Z**2).mean(0)) and np.allclose(h.means, 0)


FITS = [D.Exponential(), D.Poisson(), D.Normal(covariance_type="diag"), D.Normal(), D.Normal(covariance_type="sphere"), D.Uniform(), D.HalfNormal(), D.StudentT(), D.Categorical(n_categories=12), D.JointCategorical(n_categories=(12, 12, 12)), D.IndependentComponents(distributions=[D.Exponential(), D.Poisson(), D.Normal(covariance_type="diag")])]


def same(a, b):
    flat = lambda m: [np.asarray(v, float) for f, v in sorted(vars(m).items()) if isinstance(v, np.ndarray)] + [x for d in getattr(m, "distributions", []) for x in flat(d)]
    return all(np.allclose(x, y) for x, y in zip(flat(a), flat(b), strict=True))


@pytest.mark.parametrize("m", FITS, ids=lambda m: type(m).__name__)
def test_statistics_are_additive(table, m):
    whole = m.fit(table, C, "w")
    parts = [m.summarize(table.where(p), C, "w") for p in ("id < 4", "id between 4 and 20", "id > 20")]
    assert same(whole, m.from_summaries(*parts))
    if not isinstance(m, D.IndependentComponents):
        assert same(whole, m.update(m.stats_np(X, np.tile(W[:, None], 3))))
    if not isinstance(m, D.Uniform):  # no weight is no row; an integer weight is that many rows
        rows = table.select("*", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("i")).where("w > 0")
        assert same(whole, m.fit(rows, C))


def test_values_far_from_zero_lose_no_digits(spark):
    far = 1e9 + RNG.normal(size=(300, 2))
    df = spark.createDataFrame([tuple(map(float, r)) + (i,) for i, r in enumerate(far)], "x1 double, x2 double, i int")
    for kind, want in (("diag", far.var(0)), ("full", np.cov(far.T, bias=True))):
        m = D.Normal(covariance_type=kind)
        assert np.allclose(m.fit(df, C[:2]).covs, want, rtol=1e-5)
        parts = [m.summarize(df.where(F.col("i") % 2 == k), C[:2]) for k in (0, 1)]
        assert np.allclose(m.from_summaries(*parts).covs, want, rtol=1e-5)
    labelled = df.withColumn("y", F.col("i") % 2)
    c = BayesClassifier(distributions=[D.Normal(covariance_type="diag")] * 2).fit(labelled, C[:2], "y")
    assert np.allclose(c.distributions[1].covs, far[1::2].var(0), rtol=1e-5)


def test_missing_cells_and_inertia(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 4.0)], "x1 double, x2 double")
    assert np.allclose(D.Exponential().fit(df, ["x1", "x2"]).scales, [2, 4])
    old = D.Exponential(scales=[1.0, 1.0], inertia=0.5)
    assert np.allclose(old.fit(df, ["x1", "x2"]).scales, [1.5, 2.5])
    assert np.allclose(old.freeze().fit(df, ["x1", "x2"]).scales, [1, 1])
    assert np.allclose(old.freeze().unfreeze().fit(df, ["x1", "x2"]).scales, [1.5, 2.5])
    for bad in (lambda: D.Exponential(scales=[-1]), lambda: D.Categorical(probs=[[0.5, 0.6]]), lambda: D.Bernoulli(probs=[1.5]), lambda: KMeans(k=1), lambda: D.Normal(covariance_type="x"), lambda: D.DiracDelta(alphas=[-1])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("m,x", [(D.Exponential(), -1.0), (D.Poisson(), -1.0), (D.Gamma(), -0.5), (D.Bernoulli(), 2.0), (D.HalfNormal(), -1.0), (D.LogNormal(), 0.0), (D.Categorical(n_categories=2), 2.0), (D.Categorical(), 0.5), (D.JointCategorical(n_categories=(2,)), 2.0)], ids=lambda v: type(v).__name__)
def test_values_outside_the_support(spark, m, x):
    df = spark.createDataFrame([(x,), (1.0,), (None,)], "x double")
    with pytest.raises(ValueError):
        m.fit(df, ["x"])


def test_fits_of_zeros_are_defined(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0)], "id int, x double")
    assert column(D.Poisson().fit(df, ["x"]).log_probability(df, ["x"], "lp"), "lp") == [0.0, 0.0]
    e = D.Exponential().fit(df, ["x"])
    assert column(e.log_probability(df.withColumn("x", F.col("id").cast("double")), ["x"], "lp"), "lp") == [math.inf, NO]


def test_tables(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 1), (1, None)], "a int, b int")
    j = D.JointCategorical().fit(df, ["a", "b"])
    assert np.allclose(j.probs, [[0.25, 0.5], [0, 0.25]])
    c = D.ConditionalCategorical(n_categories=(3, 2)).fit(df, ["a", "b"])
    assert np.allclose(c.probs, [[1 / 3, 2 / 3], [0, 1], [0.5, 0.5]])
    t = D.JointCategorical(probs=[[0.1, 0.2], [0.3, 0.4]])
    ask = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 5, 0), (3, -1, 0), (4, None, 0)], "id int, a int, b int")
    got = column(t.log_probability(ask, ["a", "b"], "lp"), "lp")
    assert np.isclose(got[0], math.log(0.2)) and got[1:4] == [NO] * 3 and got[4] is None
    assert t.logp_np(np.array([[0, 1], [0, 2]], float)).tolist() == [math.log(0.2), NO]
    m = GeneralMixtureModel(distributions=[t, D.JointCategorical(probs=[[0.4, 0.3], [0.2, 0.1]])])  # a table is a component like any other
    n = m.from_summaries(m.summarize(df.dropna(), ["a", "b"]))
    assert np.isclose(n.distributions[0].probs.sum(), 1) and n.distributions[0].probs[1, 0] == 0
    with pytest.raises(NotImplementedError):
        c.marginal(0)
    two = D.ConditionalComponents(distributions=[c, D.ConditionalCategorical(probs=[[0.5, 0.5], [0.2, 0.8], [0.1, 0.9]])])
    ask = spark.createDataFrame([(0, 0, 1, 1), (1, 1, 1, 0)], "id int, a int, b int, c int")
    assert np.allclose(column(two.probability(ask, [["a", "b"], ["a", "c"]], "p"), "p"), [2 / 3 * 0.5, 1.0 * 0.2])
    assert two.draw_given(np.random.default_rng(0), [[[0], [1]], [[0], [1]]]).shape == (2, 2)
    again = D.from_dict(json.loads(two.to_json()))
    assert np.allclose(again.distributions[0].probs, c.probs)


def test_zero_inflated(spark):
    rng = np.random.default_rng(0)
    x = np.where(rng.random(2000) < 0.4, 0, rng.poisson(5.0, 2000)).astype(float)
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(x)], "x double, i int")
    z = D.ZeroInflated(distribution=D.Poisson())
    m = z.fit(df, ["x"])
    assert abs(m.priors[0] - 0.6) < 0.05 and abs(m.distribution.lambdas[0] - 5) < 0.3
    whole = m.from_summaries(m.summarize(df, ["x"]))
    parts = m.from_summaries(*[m.summarize(df.where(F.col("i") % 2 == k), ["x"]) for k in (0, 1)])
    kernel = m.update(m.stats_np(x[:, None], np.ones((2000, 1))))
    for n in (parts, kernel):
        assert np.isclose(whole.priors[0], n.priors[0]) and np.isclose(whole.distribution.lambdas[0], n.distribution.lambdas[0])
    assert m.freeze().fit(df, ["x"]).priors is m.priors


# ---- mixtures, classifiers, clusters ----


def mixture(**kw):
    return GeneralMixtureModel(distributions=[D.Exponential(scales=[2.5, 0.8, 3.0]), D.Exponential(scales=[1.2, 3.5, 0.9])], priors=[0.6, 0.4], **kw)


def emissions(m, x=X):
    return np.stack([np.log(p) + (-np.log(d.scales) - x / d.scales).sum(1) for d, p in zip(m.distributions, m.priors)], 1)


def test_mixture(table):
    m, e = mixture(), emissions(mixture())
    lp = np.logaddexp.reduce(e, 1)
    assert np.allclose(column(m.log_probability(table, C), "log_probability"), lp)
    assert np.allclose(column(m.probability(table, C), "probability"), np.exp(lp))
    assert column(m.predict(table, C), "prediction") == e.argmax(1).tolist()
    assert np.allclose(column(m.predict_proba(table, C), "probabilities"), np.exp(e - lp[:, None]))
    assert np.allclose(column(m.predict_log_proba(table, C), "log_probabilities"), e - lp[:, None])
    s, r = m.summarize(table, C, "w"), np.exp(e - lp[:, None]) * W[:, None]
    new = m.from_summaries(s)
    assert np.isclose(s["objective"], lp.sum()) and np.allclose(new.priors, r.sum(0) / r.sum())
    assert np.allclose([d.scales for d in new.distributions], (r.T @ X) / r.sum(0)[:, None])
    parts = m.from_summaries(*[m.summarize(table.where(f"id % 2 = {k}"), C, "w") for k in (0, 1)])
    assert same(new, parts)
    assert new.summarize(table, C)["objective"] >= m.summarize(table, C)["objective"] or W.std() > 0
    hard = table.withColumn("prior", F.array((1 - F.col("y")).cast("double"), F.col("y").cast("double")))
    assert column(m.predict(hard, C, "prior"), "prediction") == Y.tolist()
    assert np.allclose(column(m.log_probability(hard, C, "prior"), "log_probability"), e[np.arange(40), Y])
    assert m.freeze().fit(table, C).priors is m.priors and m.freeze().unfreeze().distributions[0].frozen is False
    assert set(m.log_probability(table, C).columns) == {*table.columns, "log_probability"}


def test_mixture_starts_from_clusters(reals):
    m = GeneralMixtureModel(distributions=[D.Normal(covariance_type="diag")] * 2, max_iter=5).fit(reals, C, order="id")
    assert np.isclose(np.sum(m.priors), 1) and all((d.covs > 0).all() for d in m.distributions)


@pytest.mark.parametrize("name", ["mixture", "full mixture", "classifier", "normal", "kmeans"])
def test_wide_models_agree_with_narrow_ones(table, reals, monkeypatch, name):
    full = GeneralMixtureModel(distributions=[D.Normal(means=Z.mean(0) + k, covs=np.cov(Z.T) + k * np.eye(3)) for k in (0, 1)], priors=[0.5, 0.5])
    c = BayesClassifier(distributions=[D.Normal(covariance_type="diag")] * 2)
    k = KMeans(centroids=X[:3])

    def all_of():
        if name == "normal":
            return [D.Normal().fit(reals, C).covs]
        if name == "kmeans":
            s = k.summarize(table, C, "w")
            return [k.from_summaries(s).centroids, s["objective"], column(k.predict(table, C), "prediction"), column(k.transform(table, C), "distances")]
        if name == "classifier":
            m = c.fit(table, C, "y", "w")
            return [m.priors, *[d.covs for d in m.distributions], column(m.predict_proba(table, C), "probabilities")]
        m, df = (mixture(), table) if name == "mixture" else (full, reals)
        df = df.withColumn("prior", F.array(F.lit(0.3), F.lit(0.7)))
        s = m.summarize(df, C, prior="prior")
        return [s["objective"], m.from_summaries(s).priors, column(m.log_probability(df, C, "prior"), "log_probability"), column(m.predict(df, C), "prediction"), column(m.predict_log_proba(df, C), "log_probabilities")]

    narrow = all_of()
    monkeypatch.setattr(arrow, "WIDE", 0)
    for a, b in zip(narrow, all_of(), strict=True):
        assert np.allclose(a, b)


def test_wide_gaussian(spark):
    """A full covariance of 40 columns, 820 statistics, in one pass."""
    x = RNG.normal(size=(500, 40)) @ RNG.normal(size=(40, 40)) + 100
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{j} double" for j in range(40)))
    m = D.Normal().fit(df, df.columns)
    assert np.allclose(m.means, x.mean(0)) and np.allclose(m.covs, np.cov(x.T, bias=True))


def test_kmeans(table):
    m = KMeans(centroids=[[1, 0, 1], [2, 3, 2], [50, 50, 50]])
    d = np.sqrt(((X[:, None] - m.centroids) ** 2).mean(2))
    assert column(m.predict(table, C), "prediction") == d.argmin(1).tolist()
    assert np.allclose(column(m.transform(table, C), "distances"), d)
    at = d.argmin(1)
    want = np.array([np.average(X[at == k], axis=0, weights=W[at == k]) for k in (0, 1)])
    got = m.one_step(table, C, "w")[1].centroids
    assert np.allclose(got[:2], want) and got[2].tolist() == [50, 50, 50]  # an empty cluster stays
    parts = m.from_summaries(*[m.summarize(table.where(f"id % 2 = {k}"), C, "w") for k in (0, 1)])
    assert np.allclose(parts.centroids, got)
    assert m.freeze().fit(table, C).centroids is m.centroids
    for init in ("first-k", "random", "submodular-facility-location", "submodular-feature-based"):
        assert KMeans(k=2, init=init).fit(table, C, order="id").centroids.shape == (2, 3)
    with pytest.raises(ValueError):
        KMeans(k=3).fit(table.limit(2), C)
    assert np.allclose(D.from_dict(json.loads(m.to_json())).centroids, m.centroids)


def test_classifier(table):
    m = BayesClassifier(distributions=[D.Exponential(), D.Exponential()]).fit(table, C, "y")
    for k in (0, 1):
        assert np.allclose(m.distributions[k].scales, X[Y == k].mean(0))
    assert np.allclose(m.priors, [(Y == 0).mean(), (Y == 1).mean()])
    parts = m.from_summaries(*[m.summarize(table.where(f"id % 2 = {k}"), C, "y") for k in (0, 1)])
    assert same(m, parts)


# ---- sequences ----

STEPS = RNG.exponential(2.0, (3, 5, 2))


def hmm(cls=DenseHMM, **kw):
    if cls is SparseHMM:
        kw |= dict(edge_list=((0, 0, 0.5), (0, 1, 0.4), (1, 0, 0.3), (1, 1, 0.5)))
    else:
        kw |= dict(edges=[[0.5, 0.4], [0.3, 0.5]])
    return cls(distributions=[D.Exponential(scales=[1.0, 3.0]), D.Exponential(scales=[2.5, 1.5])], starts=[0.3, 0.7], ends=[0.1, 0.2], **kw)


@pytest.fixture(scope="module")
def steps(spark):
    rows = [(s, t, *map(float, x), float(s + 1), [0.2, 0.8] if t else [1.0, 0.0]) for s, seq in enumerate(STEPS) for t, x in enumerate(seq) if t < 5 - s]
    return spark.createDataFrame(rows, "seq long, t int, x1 double, x2 double, w double, prior array<double>").cache()


def paths(x, prior=None):
    """(path, log joint probability) of every path of a sequence."""
    m = hmm()
    e = np.stack([d.logp_np(x) for d in m.distributions], 1)
    if prior is not None:
        with np.errstate(divide="ignore"):
            e = e + np.log(prior[: len(x)])
    s, en, a = np.log(m.starts), np.log(m.ends), np.log(m.edges)
    return [(q, s[q[0]] + sum(e[i, k] for i, k in enumerate(q)) + sum(a[u, v] for u, v in zip(q, q[1:])) + en[q[-1]]) for q in itertools.product((0, 1), repeat=len(x))]


@pytest.mark.parametrize("cls", [DenseHMM, SparseHMM])
def test_hmm_against_all_paths(steps, cls):
    m, S = hmm(cls), ("seq", "t", C[:2])
    seqs = [STEPS[s][: 5 - s] for s in range(3)]
    every = [paths(x) for x in seqs]
    lp = [np.logaddexp.reduce([v for _, v in p]) for p in every]
    assert np.allclose(column(m.log_probability(steps, *S), "log_probability", "seq"), lp)
    assert np.allclose(column(m.probability(steps, *S), "probability", "seq"), np.exp(lp))
    best = [k for p in every for k in max(p, key=lambda x: x[1])[0]]
    assert [r["prediction"] for r in m.viterbi(steps, *S).orderBy("seq", "t").collect()] == best
    gamma = [sum(math.exp(v - z) * np.eye(2)[list(q)] for q, v in p) for p, z in zip(every, lp)]
    got = [r["probabilities"] for r in m.predict_proba(steps, *S).orderBy("seq", "t").collect()]
    assert np.allclose(got, np.concatenate(gamma))
    assert [r["prediction"] for r in m.predict(steps, *S).orderBy("seq", "t").collect()] == np.concatenate(gamma).argmax(1).tolist()
    f = [r["forward"] for r in m.forward(steps, *S).orderBy("seq", "t").collect()]
    b = [r["backward"] for r in m.backward(steps, *S).orderBy("seq", "t").collect()]
    assert np.allclose(np.logaddexp.reduce(np.add(f, b), 1), np.repeat(lp, [5, 4, 3]))
    # one round of training, with weights
    w = [1.0, 2.0, 3.0]
    s = m.summarize(steps, *S, "w")
    g = m.from_summaries(s)
    trans = sum(wi * math.exp(v - z) * np.eye(4)[2 * a + c] for wi, p, z in zip(w, every, lp) for q, v in p for a, c in zip(q, q[1:])).reshape(2, 2)
    last = sum(wi * x[-1] for wi, x in zip(w, gamma))
    out = trans.sum(1) + last
    edges = np.zeros((2, 2))
    if cls is SparseHMM:
        for a, c, p in g.edge_list:
            edges[a, c] = p
    else:
        edges = g.edges
    assert np.allclose(edges, trans / out[:, None]) and np.allclose(g.ends, last / out)
    mass = sum(wi * x.sum(0) for wi, x in zip(w, gamma))
    assert np.allclose([d.scales for d in g.distributions], sum(wi * x.T @ y for wi, x, y in zip(w, gamma, seqs)) / mass[:, None])
    halves = m.from_summaries(*[m.summarize(steps.where(f"seq {o} 1"), *S, "w") for o in ("<", ">=")])
    assert np.allclose(halves.ends, g.ends) and np.allclose(halves.starts, g.starts)
    fitted = hmm(cls, max_iter=4, tol=NO).fit(steps, *S)
    assert fitted.summarize(steps, *S)["objective"] > m.summarize(steps, *S)["objective"]
    again = D.from_dict(json.loads(m.to_json()))
    assert np.allclose(column(again.log_probability(steps, *S), "log_probability", "seq"), lp)
    assert m.freeze().fit(steps, *S).starts is m.starts and m.freeze().unfreeze().frozen is False
    path, x = m.draw(np.random.default_rng(0), 20, 6)
    assert path.shape == (20, 6) and x.shape == (20, 6, 2)


def test_hmm_priors(steps):
    prior = np.array([[1.0, 0.0]] + [[0.2, 0.8]] * 4)
    want = [np.logaddexp.reduce([v for _, v in paths(STEPS[s][: 5 - s], prior)]) for s in range(3)]
    got = column(hmm().log_probability(steps, "seq", "t", C[:2], prior="prior"), "log_probability", "seq")
    assert np.allclose(got, want)
    first = hmm().predict(steps, "seq", "t", C[:2], prior="prior").where("t = 0")
    assert set(column(first, "prediction", "seq")) == {0}
    hmm(max_iter=2).fit(steps, "seq", "t", C[:2], prior="prior")


def test_impossible_sequences_count_for_nothing(spark, steps):
    bad = spark.createDataFrame([(9, 0, -1.0, 1.0, 5.0, [0.5, 0.5])], steps.schema)
    m, S = hmm(), ("seq", "t", C[:2])
    assert np.allclose(m.from_summaries(m.summarize(steps.unionAll(bad), *S, "w")).edges, m.from_summaries(m.summarize(steps, *S, "w")).edges)
    assert column(m.log_probability(bad, *S), "log_probability", "seq") == [NO]
    assert m.from_summaries(m.summarize(bad, *S)) is m
    assert m.log_probability(bad.where("1 = 0"), *S).count() == 0


def test_hmm_built_by_hand_and_started(steps):
    m = DenseHMM().add_distributions(hmm().distributions).add_edges([(0, 0, 0.5), (0, 1, 0.4), (1, 0, 0.3), (1, 1, 0.5), (None, 0, 0.3), (None, 1, 0.7), (0, None, 0.1), (1, None, 0.2)])
    S = ("seq", "t", C[:2])
    assert np.allclose(column(m.log_probability(steps, *S), "log_probability", "seq"), column(hmm().log_probability(steps, *S), "log_probability", "seq"))
    new = DenseHMM(distributions=[D.Exponential(), D.Exponential()], max_iter=2)
    assert all(d.known() for d in new.fit(steps, *S, "w").distributions)
    for bad in (lambda: SparseHMM(distributions=hmm().distributions), lambda: DenseHMM(distributions=hmm().distributions, starts=[2.0, 0.0]), lambda: m.add_edge(0, 1, 1)):
        with pytest.raises(ValueError):
            bad()


def test_sparse_kernels_make_no_table_of_all_pairs(spark):
    k = 3000
    ring = tuple((i, (i + 1) % k, 0.9) for i in range(k))
    m = SparseHMM(distributions=[D.Exponential(scales=[1.0 + i % 7]) for i in range(k)], edge_list=ring, ends=np.full(k, 0.1))
    df = spark.createDataFrame([(0, t, float(t + 1)) for t in range(6)], "seq long, t int, x double")
    e = np.array([[-math.log(1.0 + i % 7) - (t + 1) / (1.0 + i % 7) for i in range(k)] for t in range(6)])
    want = np.logaddexp.reduce([math.log(1 / k) + sum(e[t, (i + t) % k] for t in range(6)) + 5 * math.log(0.9) + math.log(0.1) for i in range(k)])
    assert np.isclose(column(m.log_probability(df, "seq", "t", ["x"]), "log_probability", "seq")[0], want)


def test_markov_chain(spark):
    seqs = RNG.integers(0, 3, (25, 4))
    df = spark.createDataFrame([(i, t, int(c), int(c != 1)) for i, s in enumerate(seqs) for t, c in enumerate(s)], "seq long, t int, x int, z int")
    m = MarkovChain(k=2).fit(df, "seq", "t", "x")
    assert np.allclose(m.tables[0], np.bincount(seqs[:, 0], minlength=3) / 25)
    got = column(m.log_probability(df, "seq", "t", "x"), "log_probability", "seq")
    want = [sum(math.log(v) for v in (m.tables[0][a], m.tables[1][a, b], m.tables[2][a, b, c], m.tables[2][b, c, d])) for a, b, c, d in seqs]
    assert np.allclose(got, want)
    assert np.allclose(column(m.probability(df, "seq", "t", "x"), "probability", "seq"), np.exp(want))
    parts = MarkovChain(k=2, n_categories=3)
    parts = parts.from_summaries(*[parts.summarize(df.where(f"seq % 2 = {k}"), "seq", "t", "x") for k in (0, 1)])
    assert all(np.allclose(a, b) for a, b in zip(parts.tables, m.tables))
    both = MarkovChain(k=2).fit(df, "seq", "t", ["x", "z"])
    one = MarkovChain(k=2, n_categories=3).fit(df, "seq", "t", "z")
    want = np.add(column(m.log_probability(df, "seq", "t", "x"), "log_probability", "seq"), column(one.log_probability(df, "seq", "t", "z"), "log_probability", "seq"))
    assert both.d == 2 and np.allclose(column(both.log_probability(df, "seq", "t", ["x", "z"]), "log_probability", "seq"), want)
    assert m.draw(np.random.default_rng(0), 5, 7).shape == (5, 7) and both.draw(np.random.default_rng(0), 5, 7).shape == (5, 7, 2)
    again = D.from_dict(json.loads(m.to_json()))
    assert np.allclose(again.tables[2], m.tables[2]) and m.freeze().fit(df, "seq", "t", "x").frozen
    beyond = spark.createDataFrame([(0, 0, 7)], "seq long, t int, x int")
    assert column(m.log_probability(beyond, "seq", "t", "x"), "log_probability", "seq") == [NO]
    with pytest.raises(ValueError):
        m.fit(beyond, "seq", "t", "x")


# ---- graphs ----


def host(chosen, prize):
    """The game show's host opens a door that is neither the guest's nor the prize's, any of those alike."""
    p = np.array([float(d not in (chosen, prize)) for d in range(3)])
    return p / p.sum()


MONTY = [[host(g, p) for p in range(3)] for g in range(3)]


def network():
    m = BayesianNetwork()
    third = D.Categorical(probs=[np.full(3, 1 / 3)])
    m.add_distributions([third, third, D.ConditionalCategorical(probs=MONTY)])
    m.add_edges([(0, 2), (1, 2)])
    return m


def test_belief_propagation(spark):
    m, cols = network(), ["guest", "prize", "monty"]
    asked = [(i, *x) for i, x in enumerate(itertools.product((None, 0, 1, 2), repeat=3))]
    joint = np.einsum("a,b,abc->abc", np.full(3, 1 / 3), np.full(3, 1 / 3), np.array(MONTY))
    ask = spark.createDataFrame([x for x in asked if x[3] is None], "id long, guest int, prize int, monty int")
    got = column(m.predict_proba(ask, cols), "probabilities")
    for (_, g, p, _), r in zip([x for x in asked if x[3] is None], got):
        sub = joint[slice(None) if g is None else slice(g, g + 1), slice(None) if p is None else slice(p, p + 1)]
        assert np.allclose(r[2], sub.sum((0, 1)) / sub.sum(), atol=1e-5)
    whole = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 0, 0), (2, 0, 1, 3)], "id long, guest int, prize int, monty int")
    lp = column(m.log_probability(whole, cols), "log_probability")
    assert np.isclose(lp[0], math.log(1 / 9)) and lp[1:] == [NO, NO]
    assert np.isclose(column(m.probability(whole, cols), "probability")[0], 1 / 9)
    x = m.draw(np.random.default_rng(1), 4000)
    assert ((x[:, 2] != x[:, 0]) & (x[:, 2] != x[:, 1])).all()
    again = D.from_dict(json.loads(m.to_json()))
    assert np.allclose(again.tables[2], MONTY) and again.structure == m.structure
    for bad in (lambda: m.add_edge(0, 0), lambda: m.add_edge(0, 9), lambda: m.add_edge(0, 1), lambda: m.add_distribution("x")):
        with pytest.raises(ValueError):
            bad()


def test_network_batches(spark):
    x = RNG.integers(0, 2, (200, 3))
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "id long, a int, b int, c int")
    m, cols = BayesianNetwork(((), (0,), (0, 1))), ["a", "b", "c"]
    whole = m.fit(df, cols)
    parts = m.from_summaries(*[m.summarize(df.where(f"id % 3 = {k}"), cols) for k in (0, 1, 2)])
    assert all(np.allclose(a, b) for a, b in zip(whole.tables, parts.tables)) and m.tables == []
    n = np.zeros((2, 2, 2))
    np.add.at(n, tuple(x.T), 1)
    assert np.allclose(whole.tables[2], n / n.sum(2, keepdims=True))
    assert whole.freeze().fit(df.limit(3), cols).tables is whole.tables
    with pytest.raises(ValueError):
        BayesianNetwork().summarize(df, cols)


#: A small grid, and the trees and networks that not-a-number scores give on it, which pin ``compat``.
GRID = "1200 0010 1110 1211 1101 0101 0100 1011 1101 0210 0001".split()
COMPAT_TREE, COMPAT_EXACT, COMPAT_ONE_PARENT = ((), (0,), (0,), (0,)), ((), (0,), (0, 1), ()), ((), (0,), (), ())


def test_structure_learning(spark, monkeypatch):
    df = spark.createDataFrame([tuple(map(int, r)) for r in GRID], "c0 int, c1 int, c2 int, c3 int")
    cols = ["c0", "c1", "c2", "c3"]
    cards = {"c0": 2, "c1": 3, "c2": 2, "c3": 2}
    s = mutual_information(df, cols, cards)
    x = np.array([list(map(int, r)) for r in GRID])
    for i, j in itertools.combinations(range(4), 2):
        n = np.zeros((3, 3))
        np.add.at(n, (x[:, i], x[:, j]), 1)
        m = np.outer(n.sum(1), n.sum(0)) / 11
        assert np.isclose(-s[i, j], sum(v * math.log(v / w) for v, w in zip(n.ravel(), m.ravel()) if v))
    trees = [t for t in itertools.combinations(list(itertools.combinations(range(4), 2)), 3) if len({v for e in t for v in e}) == 4 and np.linalg.matrix_rank([[(v == a) - (v == b) for v in range(4)] for a, b in t]) == 3]
    assert np.isclose(sum(s[i, p[0]] for i, p in enumerate(chow_liu(s)) if p), min(sum(s[e] for e in t) for t in trees))
    assert chow_liu(mutual_information(df, cols, cards, compat=True)) == COMPAT_TREE
    assert exact(df, cols, cards) == ((), (), (), ())
    assert exact(df, cols, cards, compat=True) == COMPAT_EXACT
    assert exact(df, cols, cards, max_parents=1, compat=True) == COMPAT_ONE_PARENT
    m = BayesianNetwork(algorithm="chow-liu").fit(df, cols)
    assert np.isfinite(column(m.log_probability(df, cols), "log_probability", "c0")).all()
    for bad in (lambda: BayesianNetwork(algorithm="other"), lambda: exact(df, [f"v{i}" for i in range(17)], {})):
        with pytest.raises(ValueError):
            bad()
    # strong dependence: b copies a, c is their opposite, d is alone
    rows = [(a, a, 1 - a, d) for a in (0, 1) for d in (0, 1) for _ in range(30)]
    learnt = BayesianNetwork(algorithm="exact").fit(spark.createDataFrame(rows, "a int, b int, c int, d int"), ["a", "b", "c", "d"]).structure
    assert learnt[0] == () and learnt[1] == (0,) and learnt[2] in ((0,), (1,)) and learnt[3] == ()


def test_contingency_by_either_way(spark, monkeypatch):
    x = RNG.integers(0, 3, (300, 4))
    df = spark.createDataFrame([(*map(int, r), float(i % 5)) if i % 7 else (None, *map(int, r[1:]), 1.0) for i, r in enumerate(x)], "a int, b int, c int, d int, w double")
    sets, cards = [("a",), ("a", "c"), ("b", "c", "d")], dict.fromkeys("abcd", 3)
    one = counts.contingency(df, sets, cards, F.col("w"))
    monkeypatch.setattr(counts, "PATTERNS", 1)
    two = counts.contingency(df, sets, cards, F.col("w"))
    assert all(np.allclose(one[s], two[s]) for s in sets)
    want = np.zeros((3, 3))
    for i, r in enumerate(x):
        if i % 7:
            want[r[0], r[2]] += i % 5
    assert np.allclose(one["a", "c"], want)
    for ways in (1, 1 << 17):
        monkeypatch.setattr(counts, "PATTERNS", ways)
        with pytest.raises(ValueError):
            counts.contingency(df, sets, cards | {"b": 2})
    with pytest.raises(ValueError):
        counts.contingency(df, [("a", "b")], {"a": 1 << 13, "b": 1 << 13})


def test_factor_graph(spark):
    g = FactorGraph()
    f = g.add_factor(D.JointCategorical(probs=[[0.1, 0.4], [0.3, 0.2]]))
    for _ in (0, 1):
        g.add_edge(g.add_marginal(D.Categorical(probs=[[0.5, 0.5]])), f)
    df = spark.createDataFrame([(0, 1, None), (1, 1, 0), (2, 2, 0)], "id long, a int, b int")
    p = column(g.predict_proba(df.where("id < 2"), ["a", "b"]), "probabilities")
    assert np.allclose(p[0][1], [0.6, 0.4], atol=1e-6)
    lp = column(g.log_probability(df, ["a", "b"]), "log_probability")
    assert lp[0] is None and np.isclose(lp[1], math.log(0.3 / 4)) and lp[2] == NO
    data = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(30)], "id int, a int, b int")
    whole = g.fit(data, ["a", "b"])
    parts = g.from_summaries(*[g.summarize(data.where(f"id % 4 {o} 1"), ["a", "b"]) for o in ("<=", ">")])
    n = np.zeros((2, 2))
    for i in range(30):
        n[i % 2, int(i % 3 == 0)] += 1
    assert np.allclose(whole.factors[0].probs, n / 30) and np.allclose(parts.factors[0].probs, n / 30)
    assert np.allclose(g.factors[0].probs, [[0.1, 0.4], [0.3, 0.2]])  # fitting gives a new graph
    again = D.from_dict(json.loads(whole.to_json()))
    assert np.allclose(again.factors[0].probs, n / 30) and again.edges == g.edges
    assert np.allclose(g.freeze().fit(data, ["a", "b"]).factors[0].probs, g.factors[0].probs)
    with pytest.raises(ValueError):
        g.add_factor("x")


# ---- tables from models, streams ----


def test_sampling_and_streams(spark, tmp_path):
    m = D.IndependentComponents(distributions=[D.Gamma(shapes=[2.0], rates=[0.5]), D.Normal(means=[1.0], covs=[4.0], covariance_type="diag")])
    df = sample(spark, m, 20_000, ["a", "b"])
    r = df.agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.var_pop("b").alias("b"), F.countDistinct("id").alias("d")).first()
    assert r["n"] == r["d"] == 20_000 and abs(r["a"] - 4) < 0.1 and abs(r["b"] - 4) < 0.2
    assert df.exceptAll(sample(spark, m, 20_000, ["a", "b"], partitions=3)).isEmpty()
    assert sample_sequences(spark, hmm(), 50, 6, C[:2]).count() > 50
    out = os.path.join(tmp_path, "in")
    df.limit(1000).repartition(3).write.parquet(out)
    whole = spark.read.parquet(out)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(out)
    normal, two = D.Normal(covariance_type="diag"), KMeans(centroids=[[1.0, 0.0], [8.0, 2.0]])
    for model in (normal, two):
        inc = Incremental(model, ["a", "b"])
        q = inc.attach(stream)
        q.processAllAvailable()
        q.stop()
        if model is normal:
            want = normal.fit(whole, ["a", "b"])
            assert np.allclose(inc.model.means, want.means) and np.allclose(inc.model.covs, want.covs)
        else:
            assert np.allclose(inc.model.centroids, two.one_step(whole, ["a", "b"])[1].centroids)
    inc = Incremental(normal, ["a", "b"])  # a batch that is sent again replaces itself
    for k in (0, 0, 1, 1):
        inc(whole.where(F.col("id") % 2 == k), k)
    assert np.allclose(inc.model.means, want.means)
