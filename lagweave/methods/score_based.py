"""Forward selection of lagged parents by BIC, on one Gram matrix. It isn't in the default suite."""

from __future__ import annotations

import math

import numpy as np

from ._tools import edge, moments, t_two_sided


def from_moments(cov: np.ndarray, mean: np.ndarray, n: int, names: list[str], max_lag: int, min_bic_improvement: float = 1.0) -> list[dict]:
    return _forward(cov * (n - 1), n, names, max_lag, min_bic_improvement) if max_lag >= 1 and n > 3 else []


def run_score_based_bic(data: np.ndarray, max_lag: int, names: list[str] = (), min_bic_improvement: float = 1.0) -> list[dict]:
    """Adds the best parent while BIC falls by more than the improvement. p-values after selection aren't reported."""
    return from_moments(*moments(data, max_lag), names, max_lag, min_bic_improvement) if max_lag >= 1 and len(data) > max_lag + 3 else []


def _forward(gram: np.ndarray, n: int, names: list[str], max_lag: int, min_bic_improvement: float) -> list[dict]:
    v, out = len(names), []
    bic = lambda rss, k: n * math.log(max(rss / n, 1e-300)) + (k + 1) * math.log(n)

    def rss(target: int, chosen: list[int]) -> float:
        if not chosen:
            return gram[target, target]
        return gram[target, target] - gram[target, chosen] @ np.linalg.pinv(gram[np.ix_(chosen, chosen)]) @ gram[chosen, target]

    for target in range(v):
        chosen: list[int] = []
        best = bic(rss(target, chosen), 0)
        while len(chosen) < v * max_lag:
            trial = {i: bic(rss(target, [*chosen, i]), len(chosen) + 1) for i in range(v, len(gram)) if i not in chosen}
            i = min(trial, key=lambda k: (trial[k], k))
            if best - trial[i] <= min_bic_improvement:
                break
            chosen.append(i)
            best = trial[i]
        if chosen:
            beta = np.linalg.pinv(gram[np.ix_(chosen, chosen)]) @ gram[chosen, target]
            out += [edge(names[i % v], names[target], i // v, b) for i, b in zip(chosen, beta, strict=True)]
    return out


def coefficient_p(beta: float, error: float, dof: int) -> float:
    """The p-value that a coefficient would have without selection."""
    return t_two_sided(beta / error if error else 0.0, dof)


def run_score_based_ges(data: np.ndarray, max_lag: int, names: list[str] = (), **options) -> list[dict]:
    """Another name of greedy equivalence search."""
    from .ges import run_ges

    return run_ges(data, max_lag, names, **options)
