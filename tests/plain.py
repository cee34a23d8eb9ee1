"""Plain versions of what the library does in plans, for tests."""

from collections.abc import Sequence

import numpy as np


def average_precision(score: np.ndarray, label: np.ndarray) -> float:
    """Mean precision at the positives, equal scores as one threshold."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    last = np.r_[np.flatnonzero(np.diff(score[order])), len(score) - 1]
    gained = np.diff(np.r_[0, hits[last]])
    return float((gained * hits[last] / (last + 1)).sum() / max(hits[-1], 1))


def greedy(tables: dict, candidates: Sequence[str], members: int) -> list[tuple[str, float]]:
    """(candidate, mean average precision) of each step, with replacement; ties go to the first name.

    tables: per trajectory a (pairs, candidates) matrix and labels.
    """
    sums = {k: np.zeros(len(y)) for k, (_, y) in tables.items()}
    path: list[tuple[str, float]] = []
    for step in range(1, members + 1):
        value = [np.mean([average_precision((sums[k] + x[:, i]) / step, y) for k, (x, y) in tables.items()]) for i in range(len(candidates))]
        best = max(range(len(candidates)), key=lambda i: (round(value[i], 12), [-ord(c) for c in candidates[i]]))
        for k, (x, _) in tables.items():
            sums[k] = sums[k] + x[:, best]
        path.append((candidates[best], float(value[best])))
    return path


def relations(nodes: Sequence[str], objective: str, source: str | None = None, target: str | None = None, pairs: Sequence[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """The ordered pairs of distinct nodes that an objective is about."""
    every = [(a, b) for a in nodes for b in nodes if a != b]
    if objective == "full_structure":
        return every
    if objective == "causes_of_target":
        return [x for x in every if x[1] == target]
    if objective == "effects_of_source":
        return [x for x in every if x[0] == source]
    if objective == "compare_directions":
        return [] if source == target else [(source, target), (target, source)]
    if objective == "specific_relations":
        return [x for x in every if x in set(pairs)]
    raise ValueError(f"unknown objective {objective}")


def wilcoxon(d: np.ndarray) -> float:
    """Two-sided signed-rank p-value: exact for up to 25 differences without ties, else the normal approximation."""
    from statistics import NormalDist

    d = d[~np.isclose(d, 0)]
    n = len(d)
    if not n:
        return 1.0
    size = np.abs(d)
    order = np.argsort(size, kind="stable")
    rank = np.empty(n)
    values, start, count = np.unique(size[order], return_index=True, return_counts=True)
    rank[order] = np.repeat(start + (count + 1) / 2, count)
    w = min(rank[d > 0].sum(), rank[d < 0].sum())
    if n <= 25 and len(values) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2**n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - (count**3 - count).sum() / 48
    return float(min(1.0, 2 * NormalDist().cdf((w - n * (n + 1) / 4) / variance**0.5)))
