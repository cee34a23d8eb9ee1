"""PCMCI: stable condition selection per target, then momentary conditional independence, on one lagged covariance."""

from __future__ import annotations

import numpy as np

from ..operators.registry import Moments, causal_method
from ._tools import adjusted, edge, moments, partial, partial_p


def condition_sets(cov: np.ndarray, n: int, variables: int, max_lag: int, alpha: float) -> list[list[tuple[int, int]]]:
    """Per target its lagged parents (variable, lag), strongest first: at each size, one test given the strongest others."""
    at = lambda v, lag: lag * variables + v
    out = []
    for target in range(variables):
        parents = [(v, lag) for lag in range(1, max_lag + 1) for v in range(variables)]
        least = {x: np.inf for x in parents}
        size = 0
        while size <= max(len(parents) - 1, 0):
            keep = []
            for x in parents:
                given = [y for y in parents if y != x][:size]
                r = partial(cov, at(*x), target, tuple(at(*y) for y in given))
                least[x] = min(least[x], abs(r))
                if partial_p(r, n, size) <= alpha:
                    keep.append(x)
            parents = sorted(keep, key=lambda x: -least[x])
            size += 1
        out.append(parents)
    return out


def mci(cov: np.ndarray, n: int, names: list[str], max_lag: int, alpha: float, pc_alpha: float) -> list[dict]:
    """Every lagged link's partial correlation given the target's parents and the source's parents shifted by the lag.

    cov covers lags 0 to 2 * max_lag. Each edge has its q-value among all tests.
    """
    variables = len(names)
    at = lambda v, lag: lag * variables + v
    parents = condition_sets(cov, n, variables, max_lag, pc_alpha)
    tested = []
    for target in range(variables):
        for lag in range(1, max_lag + 1):
            for source in range(variables):
                given = {at(*x) for x in parents[target]} | {at(v, k + lag) for v, k in parents[source]}
                given -= {at(source, lag), target}
                r = partial(cov, at(source, lag), target, tuple(sorted(given)))
                tested.append((source, target, lag, r, partial_p(r, n, len(given))))
    q = adjusted([t[4] for t in tested])
    return [edge(names[s], names[t], lag, r, p, q_value=q[i]) for i, (s, t, lag, r, p) in enumerate(tested) if p <= alpha]


def from_moments(cov: np.ndarray, mean: np.ndarray, n: int, names: list[str], max_lag: int, alpha: float = 0.05, pc_alpha: float = 0.2) -> list[dict]:
    return mci(cov, n, list(names), max_lag, alpha, pc_alpha) if max_lag >= 1 and n > 3 else []


@causal_method("PCMCI", signed_score=True, moments=Moments(from_moments, reach=2))
def run_pcmci(data: np.ndarray, max_lag: int, names: list[str] = (), alpha: float = 0.05, pc_alpha: float = 0.2) -> list[dict]:
    """Lagged links at level alpha; autoregressive links count. Fewer rows than lags need give none."""
    if max_lag < 1 or len(data) <= 2 * max_lag + 3:
        return []
    return from_moments(*moments(data, 2 * max_lag), list(names), max_lag, alpha, pc_alpha)
