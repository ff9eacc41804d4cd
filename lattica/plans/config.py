"""Defaults and checks of arguments, before any job runs."""

from __future__ import annotations

#: Defaults of the engine.
NDIM, TOL, MAXITER, SEED, PRECISION = 10, 1e-6, 500, 1, 7
DIVISORS = ("p", "n1", "none")


def divisor(name: str, n: int, p: int) -> float:
    if name not in DIVISORS:
        raise ValueError(f"divisor must be one of {DIVISORS}")
    return float({"p": p, "n1": n - 1, "none": 1}[name])


def check_shape(n: int, p: int) -> None:
    if p < 2:
        raise ValueError("a matrix needs two variables or more")
    if n < 2:
        raise ValueError("a matrix needs two samples or more")


def check_ndim(k: int, n: int, p: int) -> None:
    if k < 1:
        raise ValueError("at least one dimension must be asked for")
    most = (min(n, p) - 1) / 2
    if k > most:
        raise ValueError(f"{k} dimensions are more than the {int(most)} that fit")


def check_scca(k: int, n: int, p: int, q: int, lambda1, lambda2, maxiter: int, tol: float) -> None:
    if not 1 <= k <= min(n, p, q):
        raise ValueError(f"ndim must be between 1 and {min(n, p, q)}")
    if any(x < 0 for x in (*lambda1, *lambda2)):
        raise ValueError("penalties must not be negative")
    if maxiter < 1 or tol <= 0:
        raise ValueError("maxiter and tol must be above 0")


def check_ucca(n: int, k: int) -> None:
    if n - k - 1 <= 0:
        raise ValueError(f"{k} phenotypes need more than {k + 1} samples; there are {n}")


def check_folds(nfolds: int, n: int, opt_dim: int, ndim: int) -> None:
    if not 2 <= nfolds <= n:
        raise ValueError("nfolds must be between 2 and the number of samples")
    if not 1 <= opt_dim <= ndim:
        raise ValueError("opt_dim must be between 1 and ndim")
