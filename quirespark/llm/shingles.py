"""Hashes of word shingles, with numpy over whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from .shared import mix64

_EMPTY = np.zeros(0, np.uint64)


def words_of(data: bytes) -> list[bytes]:
    """A-Z in lower case; words are what stands between space, tab, line feed, vertical tab, form feed and carriage return."""
    return data.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash for each run of `size` words, in order; fewer words are one run as they are; no words, none."""
    if not words:
        return _EMPTY
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):  # a polynomial in an odd number, mixed at each step, so that order counts
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]) if k == size - 1 else out * np.uint64(0x9E3779B97F4A7C15) + mix64(h[k : k + n] + np.uint64(k))
    return out
