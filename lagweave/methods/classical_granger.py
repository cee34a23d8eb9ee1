"""Pairwise Granger tests as a method of the suite; operators.granger has the same as expressions over moments."""

from __future__ import annotations

import numpy as np

from ..operators.registry import Moments, causal_method
from ._tools import edge, t_two_sided


def f_upper(f: float, a: int, b: int) -> float:
    """Upper tail of the F distribution by the continued fraction of the incomplete beta function."""
    import math

    if f <= 0:
        return 1.0
    x, p, q = b / (b + a * f), b / 2, a / 2
    if x >= (p + 1) / (p + q + 2):
        return 1 - f_upper(1 / f, b, a) if f != 1 or a != b else 0.5
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x)) / p
    c, d = 1.0, 1 / (1 - (p + q) * x / (p + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return min(max(front * h, 0.0), 1.0)


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Coefficients, t statistics, residual sum of squares and degrees of freedom."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    rss, dof = float(((y - x @ beta) ** 2).sum()), len(y) - x.shape[1]
    error = np.sqrt(np.maximum(np.diag(inverse), 0) * rss / max(dof, 1))
    return beta, np.divide(beta, error, out=np.zeros_like(beta), where=error > 0), rss, dof


def from_moments(cov: np.ndarray, mean: np.ndarray, n: int, names: list[str], max_lag: int, alpha: float = 0.05, include_self_links: bool = False) -> list[dict]:
    """The same tests on covariances, in which the constant is taken out."""
    v, out = len(names), []
    if max_lag < 1 or n <= 2 * max_lag + 1:
        return []

    def fit(j: int, at: list[int]) -> tuple[np.ndarray, np.ndarray, float, int]:
        inverse = np.linalg.pinv(cov[np.ix_(at, at)])
        beta = inverse @ cov[at, j]
        rss, dof = max(float(cov[j, j] - cov[j, at] @ beta), 0.0) * (n - 1), n - len(at) - 1
        error = np.sqrt(np.maximum(np.diag(inverse), 0) / (n - 1) * rss / max(dof, 1))
        return beta, np.divide(beta, error, out=np.zeros_like(beta), where=error > 0), rss, dof

    lagged = lambda i: [k * v + i for k in range(1, max_lag + 1)]
    for j in range(v):
        beta0, t0, rss0, dof0 = fit(j, lagged(j))
        if include_self_links:
            out += [edge(names[j], names[j], k + 1, beta0[k], p) for k in range(max_lag) if (p := t_two_sided(t0[k], dof0)) <= alpha]
        for i in range(v):
            if i != j:
                beta, t, rss, dof = fit(j, lagged(j) + lagged(i))
                if dof < 1 or rss <= 0 or f_upper((rss0 - rss) / max_lag / (rss / dof), max_lag, dof) > alpha:
                    continue
                out += [edge(names[i], names[j], k + 1, beta[max_lag + k], p) for k in range(max_lag) if (p := t_two_sided(t[max_lag + k], dof)) <= alpha]
    return out


@causal_method("ClassicalGranger", signed_score=True, moments=Moments(from_moments))
def run_classical_granger(data: np.ndarray, max_lag: int, names: list[str] = (), alpha: float = 0.05, include_self_links: bool = False) -> list[dict]:
    """Lags whose joint and own tests both pass; self-links by the target's autoregression."""
    x = np.asarray(data, float)
    n = len(x) - max_lag
    if max_lag < 1 or n <= 2 * max_lag + 1:
        return []
    past = np.stack([x[max_lag - k : max_lag - k + n] for k in range(1, max_lag + 1)], axis=2)
    out, one = [], np.ones((n, 1))
    for j in range(x.shape[1]):
        y = x[max_lag:, j]
        own = np.column_stack([one, past[:, j]])
        beta0, t0, rss0, dof0 = ols(own, y)
        if include_self_links:
            out += [edge(names[j], names[j], k, beta0[k], p) for k in range(1, max_lag + 1) if (p := t_two_sided(t0[k], dof0)) <= alpha]
        for i in range(x.shape[1]):
            if i != j:
                beta, t, rss, dof = ols(np.column_stack([own, past[:, i]]), y)
                if dof < 1 or rss <= 0 or f_upper((rss0 - rss) / max_lag / (rss / dof), max_lag, dof) > alpha:
                    continue
                out += [edge(names[i], names[j], k, beta[max_lag + k], p) for k in range(1, max_lag + 1) if (p := t_two_sided(t[max_lag + k], dof)) <= alpha]
    return out
