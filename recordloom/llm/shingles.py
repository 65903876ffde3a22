"""Hashed word shingles of whole texts, computed inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text: A-Z lower-cased, cut at ASCII white space."""
        words = text.encode().lower().split() if text else ()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words.

    A text of fewer words is one shingle as a whole; one without words has none.
    """
    words = WORDS.of(text)
    if not len(words):
        return words
    count = min(size, len(words))
    value = np.full(len(words) - count + 1, count, np.uint64)
    for k in range(count):
        value = mix(value * _MIX[0] + words[k : len(words) - count + 1 + k])
    return np.unique(value)
