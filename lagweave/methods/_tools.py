"""Numeric helpers of the methods: designs, partial correlations and distribution tails."""

from __future__ import annotations

import math

import numpy as np


def standardised(x: np.ndarray) -> np.ndarray:
    s = x.std(0)
    return (x - x.mean(0)) / np.where(s > 0, s, 1.0)


def design(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Columns lag-major from lag 0: (t - lag, variable) for the rows that have all lags."""
    n = len(x) - max_lag
    return np.column_stack([x[max_lag - k : max_lag - k + n] for k in range(max_lag + 1)])


def moments(x: np.ndarray, max_lag: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Covariance, means and rows of a design."""
    d = design(np.asarray(x, float), max_lag)
    return np.atleast_2d(np.cov(d, rowvar=False)), d.mean(0), len(d)


def correlation(cov: np.ndarray) -> np.ndarray:
    """Covariance of the standardised columns; columns that don't vary stay 0."""
    s = np.sqrt(np.diag(cov))
    s = np.where(s > 0, s, 1.0)
    return cov / np.outer(s, s)


def t_two_sided(t: float, nu: int) -> float:
    """Two-sided p-value of Student's t for whole nu, by the finite sums."""
    if nu < 1:
        return 1.0
    a = math.atan(abs(t) / math.sqrt(nu))
    c2, s = math.cos(a) ** 2, math.sin(a)
    if nu % 2:
        term = total = math.cos(a)
        for j in range(2, (nu - 1) // 2 + 1):
            term *= c2 * (2 * j - 2) / (2 * j - 1)
            total += term
        inside = 2 / math.pi * (a + (s * total if nu > 1 else 0.0))
    else:
        term = total = 1.0
        for j in range(1, nu // 2):
            term *= c2 * (2 * j - 1) / (2 * j)
            total += term
        inside = s * total
    return min(max(1 - inside, 0.0), 1.0)


def partial(cov: np.ndarray, i: int, j: int, given: tuple[int, ...]) -> float:
    """Partial correlation from a covariance matrix."""
    sub = cov[np.ix_([i, j, *given], [i, j, *given])]
    if given:
        k = sub[2:, 2:]
        sub = sub[:2, :2] - sub[:2, 2:] @ np.linalg.pinv(k) @ sub[2:, :2]
    bottom = math.sqrt(max(sub[0, 0] * sub[1, 1], 0.0))
    return float(np.clip(sub[0, 1] / bottom, -1, 1)) if bottom > 1e-14 else 0.0


def partial_p(r: float, n: int, given: int) -> float:
    dof = n - 2 - given
    if dof < 1:
        return 1.0
    return t_two_sided(r * math.sqrt(dof / max(1 - r * r, 1e-15)), dof)


def fisher_z_p(r: float, n: int, given: int) -> float:
    if n - given - 3 <= 0:
        return 1.0
    z = 0.5 * math.log((1 + min(r, 1 - 1e-12)) / (1 - min(max(r, -1 + 1e-12), 1 - 1e-12))) if abs(r) < 1 else math.inf
    return math.erfc(math.sqrt(n - given - 3) * abs(z) / math.sqrt(2))


def adjusted(p: list[float]) -> list[float]:
    """Benjamini-Hochberg q-values of a family of tests, in its order."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, least = [1.0] * len(p), 1.0
    for rank in range(len(p), 0, -1):
        least = min(least, p[order[rank - 1]] * len(p) / rank)
        out[order[rank - 1]] = least
    return out


def edge(source: str, target: str, lag: int, score: float, p: float | None = None, **extras) -> dict:
    """A canonical edge; extras are what the method alone reports of it."""
    return {"source": source, "target": target, "lag": int(lag), "score": float(score), "p_value": None if p is None else float(p), **extras}
