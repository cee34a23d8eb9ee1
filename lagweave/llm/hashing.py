"""Vectorised word and shingle hashes over UTF-8 bytes, for Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
#: Lower-cases A-Z and turns tab to carriage return into a space; all other bytes stay.
_FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Turns tab to carriage return into a space and changes nothing else.
SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, U)
        known[0] = 1
        _powers[int(base)] = np.multiply.accumulate(known)
    return _powers[int(base)][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: bytes, fold: bytes = _FOLD) -> np.ndarray:
    """One hash per word of the text as folded, else lower-cased. Differences of a running polynomial, scaled by inverse powers."""
    raw = np.frombuffer(text.translate(fold), np.uint8)
    gap = np.concatenate(([True], raw == 32, [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[::2], edges[1::2]
    running = np.zeros(len(raw) + 1, U)
    np.cumsum((raw + U(1)) * _power(_BASE, len(raw)), out=running[1:])
    return mix((running[end] - running[start]) * _power(_INVERSE, len(raw) + 1)[start] + (end - start).astype(U))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles; a shorter text is one shingle, no words give none."""
    words = word_hashes(text) if text else np.empty(0, U)
    k = min(k, len(words))
    if not k:
        return np.empty(0, U)
    n = len(words) - k + 1
    found = np.full(n, k, U)
    for i in range(k):
        found = found * U(0x100000001B3) + words[i : i + n]
    return np.unique(mix(found))
