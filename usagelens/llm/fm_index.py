"""A compressed FM-index over word sequences: Burrows-Wheeler transform in a wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

_WORD = np.uint64(64)


class Bits:
    """A bit row with rank: packed words and the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-len(bits) // 64) * 64 + 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.zeros(len(ones), dtype=np.int32)
        np.cumsum(ones[:-1], out=self.before[1:])
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Symbols as one bit row per binary digit, highest first; each row is sorted by the digits above it."""

    def __init__(self, symbols: np.ndarray, digits: int) -> None:
        self.levels: list[Bits] = []
        for digit in range(digits - 1, -1, -1):
            bit = (symbols >> digit) & 1
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place (less a start that depends on the symbol alone)."""
        for digit, row in zip(range(len(self.levels) - 1, -1, -1), self.levels):
            ones = row.rank(at)
            at = np.where((symbol >> digit) & 1 == 1, row.zeros + ones, at - ones)
        return at


def sorted_by_context(text: np.ndarray, context: int) -> np.ndarray:
    """Suffix order by the first `context` symbols at least (prefix doubling)."""
    n = len(text)
    rank = text.astype(np.int64)
    size = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - size, 0)] = rank[size:] + 1
        both = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(both, kind="stable")
        size *= 2
        if size >= context:
            return order
        placed = both[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[False, placed[1:] != placed[:-1]])
        rank = new


class FMIndex:
    """Counts and groups occurrences of patterns up to `context` symbols in a text of symbols 0 .. k - 1."""

    def __init__(self, text: np.ndarray, context: int) -> None:
        symbols = int(text.max(initial=0)) + 1
        order = sorted_by_context(text, context)
        transform = text[order - 1]
        self.size = len(text)
        self.matrix = WaveletMatrix(transform, max(1, int(symbols - 1).bit_length()))
        # The matrix's rank is counted from where the symbol's block starts in its last order.
        self.start = self.matrix.rank(np.arange(symbols), np.zeros(symbols, dtype=np.int64))
        counts = np.bincount(text, minlength=symbols)
        self.first = np.cumsum(counts) - counts
        self.counts = counts

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the interval of symbol + pattern from the interval of the pattern."""
        shift = self.first[symbol] - self.start[symbol]
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        n = len(symbol)
        return both[:n] + shift, both[n:] + shift

    def matching(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of text[start : start + length] for every start, all in step.

        Returns the lower ends of the intervals of the patterns that occur at least twice, and -1 for the others,
        which leave the search as soon as one occurrence is left; and how many symbols, from the right, were
        matched twice.
        """
        group = np.full(len(starts), -1, dtype=np.int64)
        matched = np.zeros(len(starts), dtype=np.int64)
        alive = np.arange(len(starts))
        last = text[starts + length - 1]
        low, high = self.first[last], self.first[last] + self.counts[last]
        for k in range(2, length + 2):
            more = high - low > 1
            alive, low, high = alive[more], low[more], high[more]
            matched[alive] = k - 1
            if k > length or not len(alive):
                break
            low, high = self.extend(text[starts[alive] + length - k], low, high)
        group[alive] = low
        return group, matched
