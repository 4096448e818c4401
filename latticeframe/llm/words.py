"""Hashed words and shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from . import caches

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Odd multipliers for the places of a shingle.
PLACE = mix(np.arange(1, 65, dtype=U64)) | U64(1)


class WordHashes(dict):
    """64-bit hashes by word; remembers a bounded number of short words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


_KNOWN = WordHashes()
caches.register("words", _KNOWN.clear)


def hashes(words: list[bytes]) -> np.ndarray:
    return _KNOWN.of(words)


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at space, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode().lower().split()


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width` consecutive words; of the whole sequence if it has fewer; none without words."""
    if not len(h):
        return h
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, (width - span) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, U64)
    for i in range(span):
        out += h[i : len(h) - span + 1 + i] * PLACE[i]
    return np.unique(mix(out))
