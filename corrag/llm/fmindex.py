"""A compressed FM-index in numpy: suffix order, Burrows-Wheeler transform in a wavelet matrix with
packed bits, and backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order, length = np.argsort(rank, kind="stable"), 1
    while length < depth:
        key = rank * (n + 1)
        key[:n - length] += rank[length:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)))
        rank[order] = np.cumsum(fresh)
        length *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class _Bits:
    """A bit vector with rank in constant time: 64 bits a word and a running count."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self._words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self._words)
        self._before = (np.cumsum(counts) - counts).astype(np.int32)
        self.zeros = len(bits) - int(counts.sum())

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[word] + np.bitwise_count(self._words[word] & mask)


class FMIndex:
    """Counts the occurrences of patterns of up to ``depth`` symbols, found from right to left.

    ``weights`` gives every place of the text a weight; a pattern's count is the weight of its places.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, depth: int):
        order = suffix_order(symbols, depth)
        self.size, self.alphabet = len(symbols), int(symbols.max()) + 1
        self._weight = np.concatenate(([0], np.cumsum(weights[order])))
        self._first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=self.alphabet))))
        self._levels, self._shifts = [], range(max(1, int(self.alphabet - 1).bit_length()))[::-1]
        column = symbols[order - 1]  # the transform
        for shift in self._shifts:
            bits = (column >> shift & 1).astype(np.uint8)
            self._levels.append(_Bits(bits))
            column = np.concatenate((column[bits == 0], column[bits == 1]))
        self._base = self._down(np.arange(self.alphabet), np.zeros(self.alphabet, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` places of the transform lead to at the bottom of the wavelet matrix."""
        for shift, level in zip(self._shifts, self._levels):
            ones = level.ones_before(at)
            at = np.where(symbol >> shift & 1, level.zeros + ones, at - ones)
        return at

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of one-symbol patterns."""
        return self._first[symbol], self._first[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges after putting a symbol in front of each pattern."""
        both = self._down(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        shift = self._first[symbol] - self._base[symbol]
        return both[:len(symbol)] + shift, both[len(symbol):] + shift

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self._weight[high] - self._weight[low]


def repeated_windows(index: FMIndex, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, least: int) -> np.ndarray:
    """For every place whether a window that starts there occurs ``least`` times or more.

    ``starts`` and ``ends`` bound the streamed sequences. All are matched in step: a match is extended
    to the left as long as its count holds, which gives the matching statistic of its end; the next end
    tried is the largest whose window can hold the place that failed.
    """
    marks = np.zeros(len(symbols) + 1, np.int64)
    live = np.flatnonzero(ends - starts >= window)
    end = ends[live].copy()
    left, first = end.copy(), starts[live]
    low, high = np.zeros(len(live), np.int64), np.full(len(live), index.size)
    while len(live):
        fresh = left == end
        symbol = symbols[left - 1]
        new_low, new_high = index.extend(symbol, low, high)
        if fresh.any():
            new_low[fresh], new_high[fresh] = index.start(symbol[fresh])
        good = index.count(new_low, new_high) >= least
        left = left - good
        low, high = np.where(good, new_low, low), np.where(good, new_high, high)
        stop = ~good | (left == first)
        if not stop.any():
            continue
        long = stop & (end - left >= window)
        np.add.at(marks, left[long], 1)
        np.add.at(marks, end[long] - window + 1, -1)
        # A stopped match goes on at the next end; none is left once it has reached the first place.
        next_end = np.minimum(end - 1, left - 1 + window)
        end = np.where(stop, next_end, end)
        left = np.where(stop, next_end, left)
        keep = ~(stop & good) & (end - first >= window)
        live, end, left, first, low, high = (x[keep] for x in (live, end, left, first, low, high))
    return np.cumsum(marks[:-1]) > 0
