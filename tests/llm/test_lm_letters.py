"""Letters that decide alike are looked up once, and count as often as they occur."""

import numpy as np
import pytest

pytest.importorskip("zstandard")

from probspark.llm import lm  # noqa: E402


def test_alike_letters_are_looked_up_once():
    words = lm.Words([" ".join(f"prefix{i % 50}ing" for i in range(3000)) + " other x1 x2 x3 y"])
    x, _, _, slots = lm._spelled(words, np.flatnonzero(words.end > words.start))
    looked_up = 0
    for b, y, places, times in lm._alike(x, slots):
        every = np.stack([*slots, x >> (7 - b)])
        want, n = np.unique(every, axis=1, return_counts=True)
        got = np.stack([*places, y >> (7 - b)])
        order = np.lexsort(got[::-1])
        assert (got[:, order] == want).all() and (times[order] == n).all()
        looked_up += len(y)
    assert b == 7 and looked_up * 100 < 8 * len(x)
    assert list(lm._alike(x[:0], [s[:0] for s in slots])) == []


def test_slopes_of_rows_that_count_several_times():
    rng = np.random.default_rng(2)
    xs, gate, times = [rng.normal(size=500).astype(np.float32) for _ in range(4)], rng.integers(0, 3, 500), rng.integers(1, 5, 500)
    weights = rng.normal(size=(5, 4))
    once, often = ((np.zeros((5, 4)), np.zeros((5, 4, 4))) for _ in range(2))
    lm.Model._add_slopes(once, weights, xs, gate, times.astype(np.float64))
    lm.Model._add_slopes(often, weights, [np.repeat(x, times) for x in xs], np.repeat(gate, times))
    v = np.stack(xs).astype(float)
    q = 1 / (1 + np.exp(-np.clip((v * weights[gate].T).sum(0), -20, 20)))
    slope, curve = np.zeros((5, 4)), np.zeros((5, 4, 4))
    for g, x, p, n in zip(gate, v.T, q, times):
        slope[g] += n * (1 - p) * x
        curve[g] += n * (p * (1 - p) + 1e-5) * np.outer(x, x)
    for got in (once, often):
        assert np.allclose(got[0], slope) and np.allclose(got[1], curve)
