"""Neural Granger causality: a small network per target whose first layer is made sparse by group proximal steps."""

from __future__ import annotations

import numpy as np

from ..operators.registry import causal_method
from ._tools import edge, standardised


def prox(w: np.ndarray, strength: float, kind: str) -> np.ndarray:
    """w: (hidden, source, lag position). GL shrinks whole sources, GSGL also single lags, H nested groups of lags."""

    def shrink(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
        norm = np.sqrt((x**2).sum(axes, keepdims=True))
        return x * np.maximum(1 - strength / np.maximum(norm, 1e-12), 0)

    if kind == "GL":
        return shrink(w, (0, 2))
    if kind == "GSGL":
        return shrink(shrink(w, (0,)), (0, 2))
    if kind == "H":
        w = w.copy()
        for k in range(1, w.shape[2] + 1):
            w[:, :, :k] = shrink(w[:, :, :k], (0, 2))
        return w
    raise ValueError(f"unknown penalty {kind}")


@causal_method("NeuralGrangercMLP", default_kwargs={"max_iter": 400})
def run_neural_granger(
    data: np.ndarray, max_lag: int, names: list[str] = (), hidden: int = 32, lam: float = 0.5, ridge: float = 0.01, lr: float = 0.005, max_iter: int = 400,
    check_every: int = 100, patience: int = 5, penalty: str = "H", least: float = 1e-6, seed: int = 0,
) -> list[dict]:
    """Sources and lags whose first-layer norms survive. Position k of a kernel is lag max_lag - k. No p-values."""
    x = standardised(np.asarray(data, float))
    v, n = x.shape[1], len(x) - max_lag
    if max_lag < 1 or n < 3:
        return []
    past = np.stack([x[k : k + n] for k in range(max_lag)], axis=2).reshape(n, -1)  # oldest lag first
    y = x[max_lag:]
    rng = np.random.default_rng(seed)
    bound = 1 / np.sqrt(past.shape[1])
    w1, b1 = rng.uniform(-bound, bound, (v, hidden, past.shape[1])), rng.uniform(-bound, bound, (v, hidden))
    w2, b2 = rng.uniform(-1, 1, (v, hidden)) / np.sqrt(hidden), np.zeros(v)
    best, kept, waited = np.inf, w1.copy(), 0
    for it in range(max_iter):
        for i in range(v):
            z = past @ w1[i].T + b1[i]
            a = np.maximum(z, 0)
            error = 2 * (a @ w2[i] + b2[i] - y[:, i]) / n
            back = np.outer(error, w2[i]) * (z > 0)
            w1[i] -= lr * (back.T @ past)
            b1[i] -= lr * back.sum(0)
            w2[i] -= lr * (a.T @ error + 2 * ridge * w2[i])
            b2[i] -= lr * error.sum()
            w1[i] = prox(w1[i].reshape(hidden, v, max_lag), lr * lam, penalty).reshape(hidden, -1)
        if (it + 1) % check_every == 0:
            loss = sum(float(((np.maximum(past @ w1[i].T + b1[i], 0) @ w2[i] + b2[i] - y[:, i]) ** 2).mean() + ridge * (w2[i] ** 2).sum()) for i in range(v))
            waited = 0 if loss < best else waited + 1
            if loss < best:
                best, kept = loss, w1.copy()
            if waited >= patience:
                break
    kept = w1 if not np.isfinite(best) else kept
    out = []
    for i in range(v):
        norm = np.sqrt((kept[i].reshape(hidden, v, max_lag) ** 2).sum(0))
        out += [edge(names[j], names[i], max_lag - k, norm[j, k]) for j in range(v) for k in range(max_lag) if np.sqrt((norm[j] ** 2).sum()) > least and norm[j, k] > least]
    return out
