"""Hashes of a text's words: runs of characters outside [\x20\x09-\x0D], A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker keeps in each of two generations.
KEPT_WORDS = 120_000


class Kept(dict):
    """word -> value, for the words used last: two generations of at most `most` short words, so a worker's memory is bounded whatever it reads."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def make(self, word):
        raise NotImplementedError

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) < 64:
            self.keep({word: value})
        return value

    def keep(self, some: dict) -> None:
        if len(self) + len(some) > self.most:
            self.older = dict(self)
            self.clear()
        self.update(some)

    def all(self, words: list) -> list:
        return list(map(self.__getitem__, words))


class _Hashes(Kept):
    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


_HASHES = _Hashes(KEPT_WORDS)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes (uint64) of the words of a UTF-8 text; bytes.split and lower know ASCII only."""
    words = text.lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
