"""Hashes of words and of word runs inside Python tasks.

Texts are taken as UTF-8 bytes: ``bytes.lower`` changes A-Z only and ``bytes.split`` parts at the blank and the controls 9 to 13 only,
which is just the rule for words.
"""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


class WordHashes(dict):
    """Hashes by word, remembered up to a bound; a subclass may put more into a hash."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        self[word] = value = self.value(word)
        return value

    def value(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
