"""Words, word hashes and shingles, shared by the text operators.

A word is a run of bytes other than space, tab, LF, VT, FF and CR, which is
what ``bytes.split()`` cuts on.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: str | None, lower: bool = True) -> list[bytes]:
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    return (raw.lower() if lower else raw).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, wrapping on overflow."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle, an empty one none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, k)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total = mix64(total + _MIX[0] + hashes[j : n - width + 1 + j])
    return np.unique(total)
