"""Fast causal inference over a time-unrolled design: skeleton, possible d-separation, colliders and orientation rules.

m[i, j] is the mark at j of the edge between i and j: NONE, CIRCLE, ARROW or TAIL. Current variables can't cause lagged
ones, so an edge between them has an arrow at the current end from the start. The rules for selection bias (5 to 7) aren't
applied.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from ..operators.registry import Moments, causal_method
from ._tools import correlation, edge, fisher_z_p, moments, partial

NONE, CIRCLE, ARROW, TAIL = range(4)


class Search:
    """State of one run: covariance, marks, separating sets and, per node, whether it is lagged."""

    def __init__(self, cov: np.ndarray, n: int, lagged: np.ndarray, alpha: float, depth: int):
        self.cov, self.n, self.lagged, self.alpha = cov, n, lagged, alpha
        self.size = len(cov)
        self.depth = self.size if depth < 0 else depth
        self.m = np.full((self.size, self.size), CIRCLE)
        np.fill_diagonal(self.m, NONE)
        self.sets: dict[tuple[int, int], set[int]] = {}

    def near(self, i: int) -> list[int]:
        return [int(j) for j in np.flatnonzero(self.m[i] != NONE)]

    def apart(self, i: int, j: int, given: tuple[int, ...]) -> bool:
        return fisher_z_p(partial(self.cov, i, j, given), self.n, len(given)) > self.alpha

    def cut(self, i: int, j: int, given: tuple[int, ...]) -> None:
        self.m[i, j] = self.m[j, i] = NONE
        self.sets[min(i, j), max(i, j)] = set(given)

    def skeleton(self) -> None:
        """Edges go at the first separating set; neighbours are those from the start of each depth."""
        for size in range(self.depth + 1):
            before = {i: self.near(i) for i in range(self.size)}
            if max(map(len, before.values()), default=0) <= size:
                break
            for i, j in [(i, j) for i in range(self.size) for j in before[i]]:
                if self.m[i, j] == NONE:
                    continue
                for given in combinations([k for k in before[i] if k != j], size):
                    if self.apart(i, j, given):
                        self.cut(i, j, given)
                        break

    def mark(self, i: int, j: int, kind: int) -> bool:
        """Sets the mark at j if it is still a circle."""
        if self.m[i, j] != CIRCLE or (kind == ARROW and self.lagged[j] and not self.lagged[i]):
            return False
        self.m[i, j] = kind
        return True

    def colliders(self) -> None:
        self.m[self.m != NONE] = CIRCLE
        for i, j in zip(*np.nonzero(self.m), strict=True):
            if self.lagged[i] and not self.lagged[j]:
                self.m[i, j] = ARROW
        for k in range(self.size):
            for i, j in combinations(self.near(k), 2):
                if self.m[i, j] == NONE and k not in self.sets.get((min(i, j), max(i, j)), {k}):
                    self.mark(i, k, ARROW)
                    self.mark(j, k, ARROW)

    def possible_dsep(self, x: int) -> set[int]:
        """Nodes that a path from x reaches on which every inner node is a collider or part of a triangle."""
        seen, todo = {(x, y) for y in self.near(x)}, [(x, y) for y in self.near(x)]
        while todo:
            a, b = todo.pop()
            for c in self.near(b):
                if c != a and (b, c) not in seen and (self.m[a, b] == ARROW == self.m[c, b] or self.m[a, c] != NONE):
                    seen.add((b, c))
                    todo.append((b, c))
        return {c for _, c in seen} - {x}

    def prune(self) -> None:
        wide = {i: self.possible_dsep(i) for i in range(self.size)}
        for i, j in [(i, j) for i in range(self.size) for j in self.near(i)]:
            others = sorted(wide[i] - {j})
            for size in range(1, min(self.depth, len(others)) + 1):
                if self.m[i, j] == NONE:
                    break
                for given in combinations(others, size):
                    if self.apart(i, j, given):
                        self.cut(i, j, given)
                        break

    def _triples(self) -> bool:
        """Rules 1 to 3."""
        m, done = self.m, False
        for b in range(self.size):
            for a in self.near(b):
                for c in self.near(b):
                    if a == c:
                        continue
                    if m[a, c] == NONE and m[a, b] == ARROW and m[c, b] == CIRCLE:
                        done |= self.mark(c, b, TAIL)
                        done |= self.mark(b, c, ARROW)
                    if m[a, c] == CIRCLE and ((m[a, b] == ARROW and m[b, a] == TAIL and m[b, c] == ARROW) or (m[a, b] == ARROW and m[b, c] == ARROW and m[c, b] == TAIL)):
                        done |= self.mark(a, c, ARROW)
                    if m[a, c] == NONE and m[a, b] == ARROW == m[c, b]:
                        for d in set(self.near(a)) & set(self.near(c)) & set(self.near(b)):
                            if m[a, d] == CIRCLE == m[c, d] and m[d, b] == CIRCLE:
                                done |= self.mark(d, b, ARROW)
        return done

    def _discriminating(self) -> bool:
        """Rule 4: a path d ... a, b, c on which all before b are colliders and parents of c, d not next to c."""
        m = self.m
        for b in range(self.size):
            for c in self.near(b):
                if m[c, b] != CIRCLE:
                    continue
                for a in self.near(b):
                    if a == c or not (m[b, a] == ARROW and m[a, c] == ARROW and m[c, a] == TAIL):
                        continue
                    seen, todo = {a, b, c}, [a]
                    while todo:
                        x = todo.pop()
                        for d in self.near(x):
                            if d in seen or m[d, x] != ARROW:
                                continue
                            if m[d, c] == NONE:
                                if b in self.sets.get((min(d, c), max(d, c)), set()):
                                    return self.mark(c, b, TAIL) | self.mark(b, c, ARROW)
                                return self.mark(a, b, ARROW) | self.mark(c, b, ARROW) | self.mark(b, c, ARROW)
                            if m[x, d] == ARROW and m[d, c] == ARROW and m[c, d] == TAIL:
                                seen.add(d)
                                todo.append(d)
        return False

    def _tails(self) -> bool:
        """Rule 8: a -> b -> c beside a circle-arrow edge from a to c makes that edge directed."""
        m, done = self.m, False
        for a in range(self.size):
            for c in self.near(a):
                if m[a, c] == ARROW and m[c, a] == CIRCLE:
                    for b in set(self.near(a)) & set(self.near(c)):
                        if m[b, a] == TAIL and m[a, b] in (ARROW, CIRCLE) and m[b, c] == ARROW and m[c, b] == TAIL:
                            done |= self.mark(c, a, TAIL)
        return done

    def _may_lead(self, a: int, b: int) -> bool:
        """Whether the edge from a to b is not into a and not out of b."""
        return self.m[a, b] in (ARROW, CIRCLE) and self.m[b, a] != ARROW

    def _reaches(self, a: int, b: int, end: int, without: int = -1) -> bool:
        """Whether an uncovered potentially directed path a, b, ... leads to end and misses a node."""
        if not self._may_lead(a, b):
            return False
        todo = [(a, b)]
        while todo:
            path = todo.pop()
            if path[-1] == end:
                return True
            for c in self.near(path[-1]):
                if c != without and c not in path and self.m[path[-2], c] == NONE and self._may_lead(path[-1], c):
                    todo.append((*path, c))
        return False

    def _paths(self) -> bool:
        """Rules 9 and 10: uncovered potentially directed paths from a make a circle-arrow edge from a to c directed.

        Rule 9: a path to c whose second node isn't next to c. Rule 10: paths to two parents of c whose second nodes differ
        and aren't next to each other.
        """
        m, done = self.m, False
        for a in range(self.size):
            for c in self.near(a):
                if m[a, c] != ARROW or m[c, a] != CIRCLE:
                    continue
                seconds = [b for b in self.near(a) if b != c]
                if any(m[b, c] == NONE and self._reaches(a, b, c) for b in seconds):
                    done |= self.mark(c, a, TAIL)
                    continue
                parents = [p for p in self.near(c) if p != a and m[p, c] == ARROW and m[c, p] == TAIL]
                firsts = [[b for b in seconds if self._reaches(a, b, p, c)] for p in parents]
                if any(x != y and m[x, y] == NONE for one, two in combinations(firsts, 2) for x in one for y in two):
                    done |= self.mark(c, a, TAIL)
        return done

    def run(self) -> np.ndarray:
        self.skeleton()
        self.colliders()
        self.prune()
        self.colliders()
        while self._triples() or self._discriminating() or self._tails() or self._paths():
            pass
        return self.m


def from_moments(cov: np.ndarray, mean: np.ndarray, n: int, names: list[str], max_lag: int, alpha: float = 0.05, depth: int = -1, include_partial: bool = False) -> list[dict]:
    if max_lag < 1 or n <= 5:
        return []
    v = len(names)
    m = Search(correlation(cov), n, np.arange(len(cov)) >= v, alpha, depth).run()
    wanted = {TAIL: 1.0} | ({CIRCLE: 0.5} if include_partial else {})
    mark = {TAIL: "-->", CIRCLE: "o->"}
    return [edge(names[i % v], names[j], i // v, wanted[m[j, i]], edge_pattern=mark[m[j, i]]) for i in range(v, len(m)) for j in range(v) if m[i, j] == ARROW and m[j, i] in wanted]


@causal_method("FCI", moments=Moments(from_moments))
def run_fci(data: np.ndarray, max_lag: int, names: list[str] = (), alpha: float = 0.05, depth: int = -1, include_partial: bool = False) -> list[dict]:
    """Directed edges from lagged to current variables, score 1; with include_partial also circle-arrow ones, score 0.5.

    depth bounds the size of separating sets, if it isn't negative.
    """
    return from_moments(*moments(data, max_lag), names, max_lag, alpha, depth, include_partial) if max_lag >= 1 and len(data) > max_lag + 5 else []


def run_heterogeneous_fci(data: np.ndarray, max_lag: int, names: list[str] = (), **options) -> list[dict]:
    """Another name of fast causal inference."""
    return run_fci(data, max_lag, names, **options)
