"""VAR-LiNGAM: a vector autoregression whose residuals get a causal order by pairwise likelihood ratios."""

from __future__ import annotations

import numpy as np

from ..operators.registry import causal_method
from ._tools import design, edge, standardised


def _entropy(u: np.ndarray) -> float:
    """Maximum-entropy approximation for a standardised variable; its constants are published values."""
    k1, k2, gamma = 79.047, 7.4129, 0.37457
    return (1 + np.log(2 * np.pi)) / 2 - k1 * (np.log(np.cosh(u)).mean() - gamma) ** 2 - k2 * (u * np.exp(-(u**2) / 2)).mean() ** 2


def causal_order(e: np.ndarray) -> list[int]:
    """Most exogenous first; the found variable is regressed out of the others."""
    e, left, order = e.copy(), list(range(e.shape[1])), []
    while len(left) > 1:
        z = {i: standardised(e[:, i]) for i in left}
        loss = {}
        for i in left:
            loss[i] = 0.0
            for j in left:
                if i != j:
                    r = float((z[i] * z[j]).mean())
                    scale = np.sqrt(max(1 - r * r, 1e-12))
                    ratio = _entropy(z[j]) + _entropy((z[i] - r * z[j]) / scale) - _entropy(z[i]) - _entropy((z[j] - r * z[i]) / scale)
                    loss[i] += min(0.0, ratio) ** 2
        first = min(left, key=lambda i: (loss[i], i))
        order.append(first)
        left.remove(first)
        for j in left:
            e[:, j] -= e[:, first] * (np.cov(e[:, j], e[:, first], ddof=0)[0, 1] / max(e[:, first].var(), 1e-12))
    return order + left


@causal_method("VARLiNGAM", signed_score=True)
def run_var_lingam(data: np.ndarray, max_lag: int, names: list[str] = (), least: float = 1e-10) -> list[dict]:
    """Instantaneous and lagged effects larger than least."""
    x = np.asarray(data, float)
    v = x.shape[1]
    if max_lag < 1 or len(x) <= (max_lag + 1) * v + 2:
        return []
    d = design(x, max_lag)
    y, past = d[:, :v], np.column_stack([np.ones(len(d)), d[:, v:]])
    m = np.linalg.lstsq(past, y, rcond=None)[0]
    e = y - past @ m
    order = causal_order(e)
    b0 = np.zeros((v, v))
    for k, i in enumerate(order[1:], 1):
        b0[i, order[:k]] = np.linalg.lstsq(e[:, order[:k]], e[:, i], rcond=None)[0]
    effects = [b0] + [(np.eye(v) - b0) @ m[1 + (k - 1) * v : 1 + k * v].T for k in range(1, max_lag + 1)]
    return [edge(names[j], names[i], k, b[i, j]) for k, b in enumerate(effects) for i in range(v) for j in range(v) if abs(b[i, j]) > least]
