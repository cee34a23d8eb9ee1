"""LPCMCI: fast causal inference on a stationary window, each test given the parents that are known so far.

The window holds all variables at lags 0 to max_lag; what is found for a pair holds for all its copies at other times. A test
of two nodes is always given the known parents of both, at their own times, beside the separating set that is tried: this
takes the series' own memory out and keeps the tests strong. Preliminary rounds only find parents; each round starts again
from the full graph. Hidden common causes leave circles or two arrows, so only definite edges are reported.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from ..operators.registry import Moments, causal_method
from ._tools import adjusted, edge, moments, partial, partial_p
from .fci import ARROW, CIRCLE, NONE, TAIL, Search


class Window(Search):
    """A search whose nodes are lag * variables + variable; cov covers twice the lags of the window."""

    def __init__(self, cov: np.ndarray, n: int, variables: int, max_lag: int, alpha: float, depth: int):
        super().__init__(cov, n, np.zeros(0, bool), alpha, depth)
        self.v, self.max_lag, self.size = variables, max_lag, variables * (max_lag + 1)
        self.depth = self.size if depth < 0 else depth
        self.parents: dict[int, set[int]] = {}
        self.start()

    def start(self) -> None:
        self.m = np.full((self.size, self.size), CIRCLE)
        np.fill_diagonal(self.m, NONE)
        self.sets = {}
        self.arrows_of_time()

    def arrows_of_time(self) -> None:
        """Nothing later causes what is earlier."""
        lag = np.arange(self.size) // self.v
        self.m[(self.m != NONE) & (lag[:, None] > lag[None, :])] = ARROW

    def copies(self, i: int, j: int) -> list[tuple[int, int]]:
        """The pair at all times of the window."""
        first, last = min(i, j) // self.v, max(i, j) // self.v
        return [(i + k * self.v, j + k * self.v) for k in range(-first, self.max_lag - last + 1)]

    def known(self, i: int) -> set[int]:
        """The known parents of a node, as columns of the covariance."""
        shift = i // self.v * self.v
        return {p + shift for p in self.parents.get(i % self.v, ())}

    def conditions(self, i: int, j: int, given: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(sorted((set(given) | self.known(i) | self.known(j)) - {i, j}))

    def apart(self, i: int, j: int, given: tuple[int, ...]) -> bool:
        z = self.conditions(i, j, given)
        return partial_p(partial(self.cov, i, j, z), self.n, len(z)) > self.alpha

    def cut(self, i: int, j: int, given: tuple[int, ...]) -> None:
        for a, b in self.copies(i, j):
            self.m[a, b] = self.m[b, a] = NONE
            self.sets[min(a, b), max(a, b)] = {g + (a - i) for g in self.conditions(i, j, given)}

    def mark(self, i: int, j: int, kind: int) -> bool:
        if self.m[i, j] != CIRCLE:
            return False
        for a, b in self.copies(i, j):
            self.m[a, b] = kind
        return True

    def skeleton(self) -> None:
        """Pairs with a node at the present, given subsets of either node's neighbours; copies follow."""
        for size in range(self.depth + 1):
            before = {i: self.near(i) for i in range(self.size)}
            if max(map(len, before.values()), default=0) <= size:
                break
            for i, j in [(i, j) for i in range(self.size) for j in before[i] if min(i, j) < self.v]:
                if self.m[i, j] != NONE:
                    for given in combinations([k for k in before[i] if k != j], size):
                        if self.apart(i, j, given):
                            self.cut(i, j, given)
                            break

    def prune(self) -> None:
        wide = {i: self.possible_dsep(i) for i in range(self.size)}
        for i, j in [(i, j) for i in range(self.size) for j in self.near(i) if min(i, j) < self.v]:
            others = sorted(wide[i] - {j})
            for size in range(1, min(self.depth, len(others)) + 1):
                if self.m[i, j] == NONE:
                    break
                for given in combinations(others, size):
                    if self.apart(i, j, given):
                        self.cut(i, j, given)
                        break

    def colliders(self) -> None:
        self.m[self.m != NONE] = CIRCLE
        self.arrows_of_time()
        for k in range(self.size):
            for i, j in combinations(self.near(k), 2):
                if self.m[i, j] == NONE and k not in self.sets.get((min(i, j), max(i, j)), {k}):
                    self.mark(i, k, ARROW)
                    self.mark(j, k, ARROW)

    def definite(self) -> list[tuple[int, int]]:
        """(source node, present target) of the edges with a tail and an arrow."""
        return [(i, j) for j in range(self.v) for i in range(self.size) if self.m[i, j] == ARROW and self.m[j, i] == TAIL]

    def search(self, rounds: int) -> list[tuple[int, int]]:
        for _ in range(rounds):
            self.start()
            self.run()
            self.parents = {}
            for i, j in self.definite():
                self.parents.setdefault(j, set()).add(i)
        return self.definite()


def from_moments(cov: np.ndarray, mean: np.ndarray, n: int, names: list[str], max_lag: int, pc_alpha: float = 0.05, preliminary: int = 1, depth: int = -1) -> list[dict]:
    v = len(names)
    if max_lag < 1 or n <= 5:
        return []
    w = Window(cov, n, v, max_lag, pc_alpha, depth)
    found = w.search(preliminary + 1)
    tested = [(i, j) for j in range(v) for i in range(w.size) if i != j]
    given = {(i, j): w.conditions(i, j, ()) for i, j in tested}
    r = {x: partial(cov, *x, given[x]) for x in tested}
    p = {x: partial_p(r[x], n, len(given[x])) for x in tested}
    q = dict(zip(tested, adjusted([p[x] for x in tested]), strict=True))
    return [edge(names[i % v], names[j], i // v, r[i, j], p[i, j], q_value=q[i, j], edge_pattern="-->") for i, j in found]


@causal_method("LPCMCI", signed_score=True, moments=Moments(from_moments, reach=2))
def run_lpcmci(data: np.ndarray, max_lag: int, names: list[str] = (), pc_alpha: float = 0.05, preliminary: int = 1, depth: int = -1) -> list[dict]:
    """Definite edges at level pc_alpha, of the present among themselves and from the past; fewer rows than lags need give none."""
    if max_lag < 1 or len(data) <= 2 * max_lag + 5:
        return []
    return from_moments(*moments(data, 2 * max_lag), list(names), max_lag, pc_alpha, preliminary, depth)
