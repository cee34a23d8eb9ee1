"""Greedy equivalence search over a time-unrolled design, scored by BIC on one covariance matrix.

A pattern is a matrix g with g[i, j] = 1 for a mark from i towards j: i -> j has g[i, j] = 1 and g[j, i] = 0, an
undirected edge has both. Insertions run until none raises the score, then deletions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from ..operators.registry import Moments, causal_method
from ._tools import correlation, edge, moments


class Score:
    """Local BIC of a node given parents, kept per (node, parents)."""

    def __init__(self, cov: np.ndarray, n: int, discount: float):
        self.cov, self.n, self.discount, self.known = cov, n, discount, {}

    def __call__(self, node: int, parents: frozenset[int]) -> float:
        key = (node, parents)
        if key not in self.known:
            p = sorted(parents)
            rest = self.cov[node, node]
            if p:
                rest -= self.cov[node, p] @ np.linalg.pinv(self.cov[np.ix_(p, p)]) @ self.cov[p, node]
            self.known[key] = -0.5 * self.n * (1 + np.log(max(rest, np.finfo(float).eps))) - self.discount * (len(p) + 1) * np.log(self.n)
        return self.known[key]


def _parents(g: np.ndarray, i: int) -> set[int]:
    return set(np.flatnonzero((g[:, i] == 1) & (g[i] == 0)))


def _neighbours(g: np.ndarray, i: int) -> set[int]:
    return set(np.flatnonzero((g[:, i] == 1) & (g[i] == 1)))


def _adjacent(g: np.ndarray, i: int) -> set[int]:
    return set(np.flatnonzero((g[:, i] == 1) | (g[i] == 1)))


def _clique(g: np.ndarray, nodes: set[int]) -> bool:
    return all(g[a, b] or g[b, a] for a, b in combinations(nodes, 2))


def _blocked(g: np.ndarray, start: int, end: int, by: set[int]) -> bool:
    """Whether every semi-directed path from start to end meets a node of by."""
    seen, todo = {start}, [start]
    while todo:
        for j in map(int, np.flatnonzero(g[todo.pop()] == 1)):
            if j == end:
                return False
            if j not in seen and j not in by:
                seen.add(j)
                todo.append(j)
    return True


def extension(g: np.ndarray) -> np.ndarray | None:
    """A directed acyclic graph with the pattern's skeleton and colliders: sinks are peeled off one by one."""
    g, out, left = g.copy(), g.copy(), set(range(len(g)))
    while left:
        for x in sorted(left):
            near, adj = _neighbours(g, x), _adjacent(g, x)
            if not (g[x].astype(bool) & (g[:, x] == 0)).any() and all(adj - {y} <= _adjacent(g, y) for y in near):
                for y in near:
                    out[y, x], out[x, y] = 1, 0
                g[x], g[:, x] = 0, 0
                left.remove(x)
                break
        else:
            return None
    return out


def pattern(dag: np.ndarray) -> np.ndarray:
    """The equivalence class of a directed acyclic graph: colliders and what Meek's rules imply stay directed."""
    n = len(dag)
    g = ((dag + dag.T) > 0).astype(int)
    for j in range(n):
        for a, b in combinations(np.flatnonzero(dag[:, j]), 2):
            if not dag[a, b] and not dag[b, a]:
                g[j, a] = g[j, b] = 0
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in _neighbours(g, a):
                one = any(not g[c, b] and not g[b, c] for c in _parents(g, a))
                two = bool(set(np.flatnonzero((g[a] == 1) & (g[:, a] == 0))) & _parents(g, b))
                near = _neighbours(g, a) & _parents(g, b)
                three = any(not g[c, d] and not g[d, c] for c, d in combinations(near, 2))
                if one or two or three:
                    g[b, a], changed = 0, True
    return g


def _subsets(nodes: set[int], most: int):
    nodes = sorted(nodes)
    for k in range(min(len(nodes), most) + 1):
        yield from map(set, combinations(nodes, k))


def search(cov: np.ndarray, n: int, max_parents: int, discount: float, forbidden: np.ndarray) -> tuple[np.ndarray, float]:
    """The pattern and its score. forbidden[i, j] rules the edge i -> j out."""
    score, size = Score(cov, n, discount), len(cov)
    g = np.zeros((size, size), int)

    def best_insert():
        found = (1e-9, None)
        for x in range(size):
            for y in range(size):
                if x == y or g[x, y] or g[y, x] or forbidden[x, y]:
                    continue
                near, adj, base = _neighbours(g, y), _adjacent(g, x), _parents(g, y)
                na = near & adj
                for t in _subsets(near - adj, max(0, max_parents - len(na) - len(base) - 1)):
                    c = na | t
                    if len(c | base) + 1 > max_parents or any(forbidden[z, y] for z in t) or not _clique(g, c) or not _blocked(g, y, x, c):
                        continue
                    gain = score(y, frozenset(c | base | {x})) - score(y, frozenset(c | base))
                    if gain > found[0]:
                        found = (gain, (x, y, t))
        return found

    def best_delete():
        found = (1e-9, None)
        for x in range(size):
            for y in range(size):
                if x == y or not g[x, y]:
                    continue
                na, base = _neighbours(g, y) & _adjacent(g, x), _parents(g, y)
                for h in _subsets(na, len(na)):
                    if not _clique(g, na - h):
                        continue
                    rest = frozenset((na - h) | (base - {x}))
                    gain = score(y, rest) - score(y, rest | {x})
                    if gain > found[0]:
                        found = (gain, (x, y, h))
        return found

    while (step := best_insert())[1]:
        x, y, t = step[1]
        new = g.copy()
        new[x, y] = 1
        for z in t:
            new[z, y], new[y, z] = 1, 0
        dag = extension(new)
        if dag is None:
            break
        g = pattern(dag)
    while (step := best_delete())[1]:
        x, y, h = step[1]
        new = g.copy()
        new[x, y] = new[y, x] = 0
        for z in h:
            new[z, y] = 0
            if new[x, z] and new[z, x]:
                new[z, x] = 0
        dag = extension(new)
        if dag is None:
            break
        g = pattern(dag)
    dag = extension(g)
    return g, sum(score(i, frozenset(map(int, np.flatnonzero(dag[:, i])))) for i in range(size)) if dag is not None else float("nan")


def from_moments(cov: np.ndarray, mean: np.ndarray, n: int, names: list[str], max_lag: int, max_parents: int = 6, penalty_discount: float = 0.5) -> list[dict]:
    if max_lag < 1 or n <= 3:
        return []
    v = len(names)
    # population variances are 1 after scaling, which leaves the sample covariance a little above
    g, total = search(correlation(cov) * n / (n - 1), n, max_parents, penalty_discount, np.zeros((len(cov),) * 2, bool))
    told = lambda i, j: {"edge_pattern": "---" if g[j, i] else "-->", "orientation_source": "time" if g[j, i] else "pattern", "graph_score": float(total)}
    return [edge(names[i % v], names[j], i // v, 1.0, **told(i, j)) for i in range(v, len(g)) for j in range(v) if g[i, j]]


@causal_method("GES", moments=Moments(from_moments), default_kwargs={"max_parents": 6, "penalty_discount": 0.5})
def run_ges(data: np.ndarray, max_lag: int, names: list[str] = (), max_parents: int = 6, penalty_discount: float = 0.5) -> list[dict]:
    """Edges from lagged to current variables, directed or undirected in the pattern; scores are 1 and unsigned."""
    return from_moments(*moments(data, max_lag), names, max_lag, max_parents, penalty_discount) if max_lag >= 1 and len(data) > max_lag + 3 else []
