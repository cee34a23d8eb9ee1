"""DYNOTEARS: sparse structural vector autoregression under a smooth acyclicity constraint, on Gram matrices."""

from __future__ import annotations

import numpy as np

from ..operators.registry import Moments, causal_method
from ._tools import edge, moments, standardised


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor sum and squaring."""
    s = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-16)))) + 4)
    a = a / 2**s
    out = term = np.eye(len(a))
    for k in range(1, 14):
        term = term @ a / k
        out = out + term
    for _ in range(s):
        out = out @ out
    return out


def _solve(gram: np.ndarray, cross: np.ndarray, v: int, lam: float, rho: float, alpha: float, w: np.ndarray, rounds: int) -> np.ndarray:
    """Accelerated proximal gradient of 1/2n |X - XW - YA|^2 + lam |.|_1 + alpha h + rho/2 h^2; w stacks W over A."""
    step, mean = 1.0 / (np.linalg.eigvalsh(gram)[-1] + 1e-9), w.copy()

    def smooth(w: np.ndarray) -> tuple[float, np.ndarray]:
        e = expm(w[:v] * w[:v])
        h = np.trace(e) - v
        g = gram @ w - cross
        g[:v] += (alpha + rho * h) * e.T * 2 * w[:v]
        return 0.5 * np.sum(w * (gram @ w)) - np.sum(w * cross) + alpha * h + rho / 2 * h * h, g

    t = 1.0
    for _ in range(rounds):
        f, g = smooth(mean)
        while True:
            new = mean - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * lam, 0)
            np.fill_diagonal(new[:v], 0)
            d = new - mean
            if smooth(new)[0] <= f + np.sum(g * d) + np.sum(d * d) / (2 * step) + 1e-12 or step < 1e-12:
                break
            step /= 2
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        mean, t, moved = new + (t - 1) / u * (new - w), u, np.abs(new - w).max()
        w = new
        if moved < 1e-7:
            break
    return w


def from_moments(cov: np.ndarray, mean: np.ndarray, n: int, names: list[str], max_lag: int, lam: float = 0.05, threshold: float = 0.05, max_iter: int = 50, h_tol: float = 1e-8, rho_max: float = 1e16) -> list[dict]:
    return _search(cov * (n - 1) / n + np.outer(mean, mean), names, lam, threshold, max_iter, h_tol, rho_max) if n > 2 else []


@causal_method("DYNOTEARS", signed_score=True, moments=Moments(from_moments, standardised=True), default_kwargs={"max_iter": 50})
def run_dynotears(data: np.ndarray, max_lag: int, names: list[str] = (), lam: float = 0.05, threshold: float = 0.05, max_iter: int = 50, h_tol: float = 1e-8, rho_max: float = 1e16) -> list[dict]:
    """Instantaneous (lag 0) and lagged weights above the threshold, by an augmented Lagrangian."""
    if len(data) <= max_lag + 2:
        return []
    return from_moments(*moments(standardised(np.asarray(data, float)), max_lag), names, max_lag, lam, threshold, max_iter, h_tol, rho_max)


def _search(gram: np.ndarray, names: list[str], lam: float, threshold: float, max_iter: int, h_tol: float, rho_max: float) -> list[dict]:
    v = len(names)
    cross, w = gram[:, :v].copy(), np.zeros((len(gram), v))
    rho, alpha, h = 1.0, 0.0, np.inf
    for _ in range(max_iter):
        while True:
            new = _solve(gram, cross, v, lam, rho, alpha, w, 300)
            h_new = np.trace(expm(new[:v] * new[:v])) - v
            if h_new <= 0.25 * h or rho >= rho_max:
                break
            rho *= 10
        w, h = new, h_new
        alpha += rho * h
        if h <= h_tol or rho >= rho_max:
            break
    return [edge(names[i % v], names[j], i // v, w[i, j]) for i in range(len(w)) for j in range(v) if abs(w[i, j]) > threshold]
