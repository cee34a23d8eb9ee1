"""A heuristic, not in the default suite: permutation importance of lagged inputs of a small network on late rows."""

from __future__ import annotations

import numpy as np

from ._tools import design, edge, standardised


def _train(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...], steps: int, seed: int):
    """A network with hidden layers of these sizes by Adam on all rows; returns its prediction function."""
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *hidden, 1]
    p = [q for n, k in zip(sizes, sizes[1:], strict=False) for q in (rng.normal(0, 1 / np.sqrt(n), (n, k)), np.zeros(k))]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]

    def layers(q: np.ndarray) -> list[np.ndarray]:
        out = [q]
        for i in range(0, len(p), 2):
            z = out[-1] @ p[i] + p[i + 1]
            out.append(np.maximum(z, 0) if i + 2 < len(p) else z)
        return out

    for t in range(1, steps + 1):
        a = layers(x)
        back, g = 2 * (a[-1] - y[:, None]) / len(y), []
        for i in range(len(hidden), -1, -1):
            g[:0] = [a[i].T @ back, back.sum(0)]
            back = back @ p[2 * i].T * (a[i] > 0)
        for i, d in enumerate(g):
            m[i], s[i] = 0.9 * m[i] + 0.1 * d, 0.999 * s[i] + 0.001 * d * d
            p[i] -= 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return lambda q: layers(q)[-1][:, 0]


def run_mlp_permutation(data: np.ndarray, max_lag: int, names: list[str] = (), holdout: float = 0.2, threshold: float = 0.0, hidden: tuple[int, ...] = (64, 32), steps: int = 300, repeats: int = 10, seed: int = 42) -> list[dict]:
    """Lagged inputs whose shuffling raises the error on the last rows by more than the threshold; no p-values."""
    x = standardised(np.asarray(data, float))
    v = x.shape[1]
    d = design(x, max_lag)
    cut = int(len(d) * (1 - holdout))
    if max_lag < 1 or cut < 5 or len(d) - cut < 2:
        return []
    past, out, rng = d[:, v:], [], np.random.default_rng(seed)
    for j in range(v):
        predict = _train(past[:cut], d[:cut, j], hidden, steps, seed + j)
        late, y = past[cut:], d[cut:, j]
        base = ((predict(late) - y) ** 2).mean()
        for i in range(past.shape[1]):
            worse = []
            for _ in range(repeats):
                mixed = late.copy()
                mixed[:, i] = rng.permutation(mixed[:, i])
                worse.append(((predict(mixed) - y) ** 2).mean() - base)
            if np.mean(worse) > threshold:
                out.append(edge(names[i % v], names[j], i // v + 1, float(np.mean(worse))))
    return out
