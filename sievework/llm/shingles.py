"""Words and word shingles of whole texts as 64-bit hashes, for workers."""

from __future__ import annotations

import numpy as np

from sievework.llm.shared import take_room

#: Distinct words a worker remembers.
WORDS = 100_000
_known: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word."""
    import xxhash

    if not _known:
        take_room("shingles", _known.clear, for_task=True)
    elif len(_known) > WORDS:
        _known.clear()
    try:
        return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words).difference(_known):
            _known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each ``n`` consecutive values."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = h[:size].copy()
    for i in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
        out += h[i : i + size]
    return mixed(out)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct shingles of ``n`` words of a text in ASCII lower case; the whole sequence if it is shorter,
    nothing if it has no word."""
    h = word_hashes(text.lower().split())
    return np.unique(rolling(h, n if len(h) >= n else len(h))) if len(h) else np.zeros(0, np.uint64)
