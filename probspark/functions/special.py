"""Special functions for the driver and for Arrow kernels, in plain numpy."""

from __future__ import annotations

import numpy as np


def lgamma(x):
    """ln Gamma(x) for x > 0: the Stirling series at x + 8, brought back by the recurrence."""
    x = np.asarray(x, float)
    z = x + 8
    s = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9) - 691 / (360360 * z**11)
    return s - np.log(np.prod([x + k for k in range(8)], axis=0))


def digamma(x):
    x = np.asarray(x, float)
    z = x + 8
    s = np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - 1 / (132 * z**10) + 691 / (32760 * z**12)
    return s - sum(1 / (x + k) for k in range(8))


def trigamma(x):
    x = np.asarray(x, float)
    z = x + 8
    s = 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) - 1 / (30 * z**9) + 5 / (66 * z**11) - 691 / (2730 * z**13)
    return s + sum(1 / (x + k) ** 2 for k in range(8))


def logsumexp(a, axis=-1):
    """ln of the sum of exponentials along an axis; all minus infinity stays so."""
    m = np.max(a, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - m).sum(axis=axis)) + np.squeeze(m, axis)


def safe_log(p):
    with np.errstate(divide="ignore"):
        return np.log(np.asarray(p, float))
