"""A compressed full-text index over integer sequences, with array-at-a-time backward search.

The index keeps the Burrows-Wheeler transform of the sequences in a wavelet tree laid
out level by level: each level holds one bit per symbol, packed, with a running count
for every 64 bits.  A step of backward search is one walk down the levels, done for
all open patterns at once.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((n // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are set."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Rank of any symbol below ``size`` in a sequence."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            self.bits.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])
        every = np.arange(size)
        self.first = self._walk(every, np.zeros(size, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, vector, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros):
            ones = vector.ones(at)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbols[i] occurs among the first at[i] items."""
        return self._walk(symbols, at) - self.first[symbols]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` sorted by at least their first ``depth`` symbols, by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    reach = 1
    while reach < depth and n:
        following = np.zeros(n, np.int64)
        if reach < n:
            following[: n - reach] = rank[reach:]
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        reach *= 2
        if rank[order[-1]] == n:
            break
    return order


class FMIndex:
    """Index of ``text`` (symbols 0 .. size - 1) for patterns of up to ``depth`` symbols.

    The last symbol of ``text`` must be one that no pattern holds.
    """

    def __init__(self, text: np.ndarray, size: int, depth: int):
        order = suffix_order(text, depth + 1)
        self.tree = WaveletTree(text[order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)

    def repeated_lengths(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics: for each place in ``ends``, how many symbols up to and
        with it, at most ``most``, occur at least ``least`` times in the index."""
        lengths = np.zeros(len(ends), np.int64)
        open_ = np.flatnonzero(most > 0)
        low, high = np.zeros(len(open_), np.int64), np.full(len(open_), self.smaller[-1])
        step = 0
        while len(open_):
            symbols = text[ends[open_] - step]
            both = self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
            base = self.smaller[symbols]
            low, high = base + both[: len(open_)], base + both[len(open_) :]
            found = high - low >= least
            open_, low, high = open_[found], low[found], high[found]
            step += 1
            lengths[open_] = step
            more = most[open_] > step
            open_, low, high = open_[more], low[more], high[more]
        return lengths
