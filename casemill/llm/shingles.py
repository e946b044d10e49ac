"""Words and word shingles of texts as 64-bit hashes, computed over whole texts without a Python loop."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = []

WORD = np.zeros(256, bool)
WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown by doubling."""
    if not _powers or _powers[0].size < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (_BASE, _INVERSE):
            p, step = np.ones(1, np.uint64), base
            while p.size < size:
                p, step = np.concatenate([p, p * np.uint64(step)]), step * step & _MASK
            out.append(p)
        _powers[:] = out
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all (that of a public splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each maximal run of [a-z0-9] of the lower-cased text, in order."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    inside = WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    if not start.size:
        return np.zeros(0, np.uint64)
    power, inverse = _upto(data.size + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: data.size], out=sums[1:])
        return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct sequences of n consecutive words; empty if there are fewer words."""
    w = word_hashes(text)
    if w.size < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(w.size - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ w[k : k + h.size]) * np.uint64(_BASE)
            h ^= h >> np.uint64(29)
        return np.unique(mixed(h))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 0 if both are empty."""
    if not a.size or not b.size:
        return 0.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, b.size - 1)] == a).sum())
    return both / (a.size + b.size - both)
