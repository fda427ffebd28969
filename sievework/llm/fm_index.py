"""A compressed FM-index over word ids: the Burrows-Wheeler transform in a wavelet matrix of packed bits with block counts,
and every SAMPLE-th entry of the suffix array. Suffixes are sorted to a fixed depth; text and suffix array aren't kept.
Backward search takes many patterns at once."""

from __future__ import annotations

import numpy as np

#: Of the places of the text, one in so many is kept with the index, to find the others by steps through it.
SAMPLE = 32


class BitVector:
    """Bits with constant-time rank: 64-bit blocks and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.blocks.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.blocks), np.int32)
        np.cumsum(np.bitwise_count(self.blocks[:-1]), out=self.before[1:], dtype=np.int32)
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place ``i``."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, size: int):
        self.n, self.levels = len(values), max(1, int(size - 1).bit_length())
        self.bits: list[BitVector] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.bits.append(BitVector(bit))
            values = np.concatenate([values[~bit], values[bit]])
        del values
        self.start = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.bits):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            r = bits.rank(i)
            i = np.where(one, self.n - bits.ones + r, i - r)
        return i

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places ``i``."""
        symbol = np.zeros(len(i), np.int64)
        for bits in self.bits:
            r = bits.rank(i)
            one = bits.rank(i + 1) > r
            symbol = symbol * 2 + one
            i = np.where(one, self.n - bits.ones + r, i - r)
        return symbol

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before place ``i``, for arrays of both."""
        return self._walk(symbol, i) - self.start[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` sorted by their first ``depth`` symbols at least, by prefix doubling."""
    n, rank, length = len(text), text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while length < depth:
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        length *= 2
    return order


class FMIndex:
    """Index of ``text``, an array of symbols from 0 to ``size`` - 1, for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        order = suffix_order(text, depth)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.matrix = WaveletMatrix(text[order - 1], size)
        kept = order % SAMPLE == 0
        self.marks, self.places = BitVector(kept), order[kept].astype(np.uint32)

    def search(self, stream: np.ndarray, at: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the patterns ``stream[a : a + n]``: how many symbols from its end on each matches (its
        matching statistic, ``n`` at most) and the interval of that match in the order of suffixes. A pattern is given
        up where its interval holds fewer than ``least`` suffixes."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.matrix.n, np.int64)
        matched, alive, j = np.zeros(len(at), np.int64), np.flatnonzero(length > 0), 0
        while len(alive):
            symbol = stream[at[alive] + length[alive] - 1 - j]
            a = self.counts[symbol] + self.matrix.rank(symbol, low[alive])
            b = self.counts[symbol] + self.matrix.rank(symbol, high[alive])
            fits = b - a >= least
            alive, j = alive[fits], j + 1
            low[alive], high[alive] = a[fits], b[fits]
            matched[alive] = j
            alive = alive[length[alive] > j]
        return matched, low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes ``i`` in their order, by steps back to sampled ones. Exact only where the
        sorting depth told all suffixes apart."""
        out, i, open_, steps = np.zeros(len(i), np.int64), i.copy(), np.arange(len(i)), 0
        while len(open_):
            here = i[open_]
            known = self.marks.rank(here + 1) > self.marks.rank(here)
            out[open_[known]] = self.places[self.marks.rank(here[known])] + steps
            open_, here, steps = open_[~known], here[~known], steps + 1
            symbol = self.matrix.access(here)
            i[open_] = self.counts[symbol] + self.matrix.rank(symbol, here)
        return out
