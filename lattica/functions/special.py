"""The F distribution's upper tail, without scipy: for arrays, element by element."""

from __future__ import annotations

from math import lgamma

import numpy as np

#: Terms of the continued fraction; a few dozen are needed where it is used.
TERMS, TINY = 10_000, 1e-300


def away(x: np.ndarray) -> np.ndarray:
    """x without zeros."""
    return np.where(np.abs(x) > TINY, x, TINY)


def beta_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz). An element is left at its own last term: later ones only add rounding."""
    out, left = np.empty_like(x), np.arange(len(x))
    c, d = np.ones_like(x), 1 / away(1.0 - (a + b) * x / (a + 1))
    own = d.copy()
    for m in range(1, TERMS):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / away(1 + top * d)
            c = away(1 + top / c)
            own = own * c * d
        more = np.abs(c * d - 1) >= 1e-15
        out[left[~more]] = own[~more]
        left, x, c, d, own = (v[more] for v in (left, x, c, d, own))
        if not len(left):
            return out
    raise RuntimeError(f"no convergence after {TERMS} terms")


def beta_inc(a: float, b: float, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b); NaN outside of 0 to 1."""
    x = np.asarray(x, float)
    out = np.where((x >= 0) & (x <= 1), x, np.nan)
    inside = (x > 0) & (x < 1)
    low = inside & (x < (a + 1) / (a + b + 2))
    for some, p, q, turned in ((low, a, b, False), (inside & ~low, b, a, True)):
        if some.any():
            own = 1 - x[some] if turned else x[some]
            front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x[some]) + b * np.log1p(-x[some]))
            part = front * beta_fraction(p, q, own) / p
            out[some] = 1 - part if turned else part
    return out


def f_upper(r2, n: int, k: int) -> np.ndarray:
    """P(F(k, n-k-1) > F) for the F statistics of squared correlations r2; from 1-r2, so small tails stay accurate."""
    b = (n - k - 1) / 2
    return beta_inc(b, k / 2, 1 - np.asarray(r2, float)) if b > 0 else np.full(np.shape(r2), np.nan)


def wilks(r2, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R, F and P of squared multiple correlations with k variables over n rows."""
    r2 = np.atleast_1d(np.asarray(r2, float))
    with np.errstate(divide="ignore"):
        f = np.where(r2 < 1, r2 / (1 - r2) * (n - k - 1) / k, np.inf)
    return np.sqrt(r2), f, f_upper(r2, n, k)
