"""The distances of ``scalars`` on numpy arrays of counts, where every row shares something."""

from __future__ import annotations

import numpy as np

from kmerloom.functions.scalars import COEFFICIENTS, COEFFICIENTS_95, DENOMINATORS, DENOMINATORS_95, EPSILON, NAIVE_INTERCEPT, NAIVE_SLOPE, regression


def mash(shared: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    j = shared / (x + y - shared)
    return np.log((1 + j) / (2 * j)) / k


def aaf(shared: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    return np.log(1 / (shared / np.minimum(x, y))) / k


def model(xny: np.ndarray, diff: np.ndarray, sections: np.ndarray, mut2: np.ndarray) -> np.ndarray:
    x, d, s, m = (c.astype(float) for c in (xny, diff, sections, mut2))
    out = regression(x, s, m, d, DENOMINATORS, COEFFICIENTS)
    close = np.flatnonzero(out < 0.05)
    out[close] = regression(x[close], s[close], m[close], d[close], DENOMINATORS_95, COEFFICIENTS_95)
    return np.where(d == 0, 0.0, np.maximum(out, 0.0))


def naive(xny: np.ndarray, diff: np.ndarray, sections: np.ndarray) -> np.ndarray:
    x, d, s = (c.astype(float) for c in (xny, diff, sections))
    whole = 1 - (1 - d / (x + d)) ** ((s + EPSILON) / (d + EPSILON))
    return np.where(whole <= 0, 0.0, whole * NAIVE_SLOPE + NAIVE_INTERCEPT)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As doubles, halves away from zero."""
    x = x.astype(float) * 10.0**digits
    whole = np.trunc(x)
    return (whole + np.copysign(np.abs(x - whole) >= 0.5, x)) / 10.0**digits + 0.0  # no -0.0
