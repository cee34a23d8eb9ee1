"""Periodic stretches of words, found by an enhanced suffix array and its branching squares.

A run is a stretch of consecutive words with smallest period q, at least max(min_words, times * q) words long, that no
neighbouring word extends with that period. Per batch of documents, in numpy:

1. suffix array, its inverse and the longest common prefixes (LCP) of neighbours by prefix doubling; only suffixes that
   aren't told apart yet are sorted again, and none is compared beyond its document;
2. LCP intervals, from the neighbours in the array with smaller or equal LCP: no tree node is built. A square of period d
   that no word after it continues lies in an interval of depth d, its two halves in different children. For all children
   but the largest, each suffix i is tested: is the inverse at i + d, or at i - d, within the interval and outside of the
   child? For `times` repetitions, the inverses of the places before it lie in the interval as well;
3. each such square is the last of its run: it is rotated to the left, word by word, to the run's start. Squares of a
   multiple of the period end at the same word and merge into the run of the smallest period.

A run's first suffix and the one a period later share min_words * (times - 1) / times words at least, so documents of
which no two suffixes do have no run; only their suffixes are sorted, and only that far.

Edge cases: null text has no words, no runs and stays null; empty texts and texts without words have no runs. Repeated
rows are each returned, an id may be of any type or null. An empty table gives an empty result. All other columns stay;
input columns named _runs, _best or _collapsed are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import pieces

#: Words of the documents that a task searches at once; a longer document is searched alone.
BATCH = 1 << 18
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _sorted_suffixes(words: np.ndarray, first: np.ndarray, last: np.ndarray, enough: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(Suffix array, ranks by 1, 2, 4, ... leading words, slots that still held equal suffixes at the last power up to enough).

    first and last: of each word, where its document begins and ends. Each document's suffixes lie in its own slots.
    """
    n = len(words)
    key = first * (int(words.max(initial=0)) + 1) + words
    sa = np.argsort(key, kind="stable")
    starts = np.concatenate(([True], key[sa[1:]] != key[sa[:-1]]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    levels, k, equal = [rank], 1, np.empty(0, np.int64)
    while True:
        alone = starts & np.concatenate((starts[1:], [True]))
        slots = np.flatnonzero(~alone)
        if k <= enough:
            equal = slots
        if not len(slots):
            return sa, levels, equal
        at = sa[slots]
        then = at + k
        inside = then < last[at]
        second = np.where(inside, rank[np.minimum(then, n - 1)], -1)
        order = np.lexsort((second, rank[at]))
        at, second = at[order], second[order]
        group = rank[at]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        sa[slots] = at
        starts[slots] = new
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(rank)
        k *= 2


def _common(sa: np.ndarray, levels: list[np.ndarray], last: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """LCP of each slot's suffix and the one before it."""
    i, j = sa[slots - 1], sa[slots]
    end_i, end_j = last[i], last[j]
    found = np.zeros(len(slots), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = i + found, j + found
        same = (a < end_i) & (b < end_j)
        same[same] = levels[level][a[same]] == levels[level][b[same]]
        found[same] += 1 << level
    return found


def _children(lcp: list[int], base: int) -> list[tuple[int, int, int, int, int]]:
    """(interval's first and last slot, its depth, a child's first and last slot) for all children of all LCP intervals of one document; lcp[t] is that of slots base + t - 1 and base + t."""
    m = len(lcp)
    out = []
    stack: list[tuple[int, int, list[int]]] = []  # depth, first slot, boundaries between children
    for t in range(1, m + 1):
        depth = lcp[t] if t < m else 0
        left = t - 1
        while stack and stack[-1][0] > depth:
            d, left, cuts = stack.pop()
            edges = [left, *cuts, t]
            out += [(base + left, base + t - 1, d, base + edges[c], base + edges[c + 1] - 1) for c in range(len(edges) - 1)]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2].append(t)
            else:
                stack.append((depth, left, [t]))
    return out


def _squares(sa: np.ndarray, isa: np.ndarray, children: np.ndarray, times: int) -> np.ndarray:
    """Distinct (start, period) of the branching squares that end a stretch of times periods."""
    l, r, depth, lo, hi = children.T
    size = hi - lo
    order = np.lexsort((size, r, l))
    l, r, depth, lo, hi, size = (x[order] for x in (l, r, depth, lo, hi, size))
    smaller = np.concatenate(((l[1:] == l[:-1]) & (r[1:] == r[:-1]), [False]))  # the last of an interval is its largest child
    l, r, depth, lo, hi, size = (x[smaller] for x in (l, r, depth, lo, hi, size))
    which = np.repeat(np.arange(len(l)), size + 1)
    slot = np.arange(len(which)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1) + lo[which]
    at, n = sa[slot], len(sa)
    l, r, depth, lo, hi = l[which], r[which], depth[which], lo[which], hi[which]

    def within(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = isa[np.clip(place, 0, n - 1)]
        return (place >= 0) & (place < n) & (l <= s) & (s <= r), s

    found = []
    for start, other in ((at, at + depth), (at - depth, at - depth)):
        good, s = within(other)
        good &= (s < lo) | (s > hi)
        for back in range(1, times - 1):
            good &= within(start - back * depth)[0]
        found.append(np.stack((start[good], depth[good]), 1))
    return np.unique(np.concatenate(found), axis=0)


def _rotated(words: np.ndarray, start: int, period: int, floor: int, known: int) -> int:
    """The first place of the run that the square at start ends; known words before it are part of it."""
    at, step = start - known, 64
    while at > floor:
        low = max(at - step, floor)
        differs = np.flatnonzero(words[low:at] != words[low + period : at + period])
        if len(differs):
            return low + int(differs[-1]) + 1
        at, step = low, step * 2
    return at


def find_runs(documents: list[np.ndarray], min_words: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Each document's runs (start, length, period), by start and period; documents are arrays of word numbers."""
    size = [len(d) for d in documents]
    begins = np.cumsum([0, *size])[:-1]
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    words = np.concatenate(documents) if documents else np.empty(0, np.int64)
    if not len(words):
        return found
    doc = np.repeat(np.arange(len(documents)), size)
    first, last = begins[doc], (begins + size)[doc]
    enough = -(-min_words * (times - 1) // times)
    sa, levels, equal = _sorted_suffixes(words, first, last, enough)
    some = np.unique(doc[sa[equal]])
    if not len(some):
        return found
    isa = np.empty(len(sa), np.int64)
    isa[sa] = np.arange(len(sa))
    children = []
    for d in some.tolist():
        base = int(begins[d])
        lcp = [0, *_common(sa, levels, last, np.arange(base + 1, base + size[d])).tolist()]
        children += _children(lcp, base)
    ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
    squares = _squares(sa, isa, np.array(children, np.int64), times)
    for start, period in squares[np.argsort(squares[:, 1], kind="stable")].tolist():
        end = start + 2 * period
        if any(period % q == 0 and s <= start for q, s in ends[end]):
            continue
        d = int(doc[start])
        low = _rotated(words, start, period, int(begins[d]), (times - 2) * period)
        ends[end].append((period, low))
        if end - low >= min_words:
            found[d].append((low - int(begins[d]), end - low, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    left, at = [], 0
    for start, length, period in sorted(runs, key=lambda r: r[0] + r[2]):
        if start + period > at:
            left += words[at : start + period]
        at = max(at, start + length)
    return left + words[at:]


def _searched(batches: Iterator[pa.RecordBatch], min_words: int, times: int, most: int) -> Iterator[pa.RecordBatch]:
    def reduced() -> Iterator[pa.RecordBatch]:
        number = defaultdict(count().__next__)
        split = [(t or "").encode().split() for t in texts]
        runs = find_runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in split], min_words, times)
        best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None) for r in runs]
        collapsed = [None if t is None else b" ".join(_kept(w, r)).decode() for t, w, r in zip(texts, split, runs, strict=True)]
        run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays(rows), pa.array([[named(x) for x in r] for r in runs], pa.list_(run)), pa.array([named(b) for b in best], run), pa.array(collapsed, pa.string())],
            ["row", "runs", "best", "collapsed"],
        )

    rows, texts, size = [], [], 0
    for batch in pieces(batches, 16):
        rows.append(batch.column(0))
        got = batch.column(1).to_pylist()
        texts += got
        size += sum(len(t) // 4 for t in got if t)
        if size >= most:
            yield from reduced()
            rows, texts, size = [], [], 0
    if rows:
        yield from reduced()


def periodic_runs(docs: DataFrame, min_words: int = 24, times: int = 3) -> DataFrame:
    """docs(text, ...) with _runs, the _best by length over period (ties: smallest start, then period; null without runs) and _collapsed, the words outside of repetitions joined by one space."""
    if times < 3:
        raise ValueError("a run repeats its period three times at least")
    columns = [c for c in docs.columns if c not in ("_runs", "_best", "_collapsed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").cast("string").alias("text"))
    out = StructType([rows.schema["row"], *StructType.fromDDL(f"runs array<{_RUN}>, best {_RUN}").fields, StructField("collapsed", StringType())])
    found = rows.mapInArrow(lambda it: _searched(it, min_words, times, BATCH), out)
    return found.select(*[F.col(f"row.`{c}`") for c in columns], F.col("runs").alias("_runs"), F.col("best").alias("_best"), F.col("collapsed").alias("_collapsed"))
