"""Vectorised 64-bit hashing of words and word shingles (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHE_WORDS = 500_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (bijective: distinct stay distinct)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash per word; forgets all when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; fewer words: the whole sequence as one; none: empty."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(n, k)
    acc = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        acc = mix(acc * _STEP + hashes[j:n - width + 1 + j])
    return np.unique(acc)
