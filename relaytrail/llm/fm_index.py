"""A compressed full-text index over sequences of words: BWT in a wavelet matrix, searched backward.

All searches run side by side: one step extends every active pattern by one word with two rank
queries per wavelet level over packed bits.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with counts before every 64: rank in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (ones.cumsum() - ones).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels = []
        self.top = max(1, int(n_symbols - 1).bit_length())
        for level in range(self.top - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append((level, Bits(bit), int(len(symbols) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.first = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``i``."""
        return self._descend(symbol, i) - self.first[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; zeros separate and differ from each other by their place."""
    n = len(text)
    separators = text == 0
    rank = text.astype(np.int64) + int(separators.sum())
    rank[separators] = np.arange(int(separators.sum()))
    step = 1
    while True:
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2 + n) + later
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.r_[0, (np.diff(key[order]) != 0).cumsum()]
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Index of several word sequences, each with the number of times it occurs."""

    def __init__(self, sequences: list[np.ndarray], times: list[int], n_symbols: int) -> None:
        """``sequences`` of symbols 1 .. n_symbols - 1."""
        lengths = np.array([len(s) for s in sequences])
        self.text = np.zeros(int(lengths.sum()) + len(sequences), np.int64)
        self.starts = np.r_[0, (lengths + 1).cumsum()[:-1]]
        for start, s in zip(self.starts, sequences):
            self.text[start : start + len(s)] = s
        order = suffix_order(self.text)
        weights = np.repeat(np.array(times, np.int64), lengths + 1)[order]
        self.weight = np.r_[0, weights.cumsum()]
        self.smaller = np.searchsorted(self.text[order], np.arange(n_symbols + 1))
        self.bwt = WaveletMatrix(self.text[order - 1], n_symbols)

    def extend(self, ends: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Backward search of the text before and at each end, for as long as it occurs twice.

        Gives the place whose word ended the match, or ``stop - 1`` where the match reached ``stop``.
        """
        failed = stops - 1
        symbol = self.text[ends]
        low, high = self.smaller[symbol], self.smaller[symbol + 1]
        place, active = ends.copy(), np.arange(len(ends))
        while len(active):
            twice = self.weight[high] - self.weight[low] >= 2
            failed[active[~twice]] = place[~twice]
            more = twice & (place > stops[active])
            active, low, high, place = active[more], low[more], high[more], place[more] - 1
            symbol = self.text[place]
            both = self.bwt.rank(np.r_[symbol, symbol], np.r_[low, high]) + np.r_[self.smaller[symbol], self.smaller[symbol]]
            low, high = both[: len(active)], both[len(active) :]
        return failed

    def repeated(self, sequence: np.ndarray, width: int) -> np.ndarray:
        """Marks every text place where a window of ``width`` words starts that occurs twice.

        ``sequence`` are the numbers of the sequences to stream. A range of windows is tried whole
        from its right end; what the match covers is marked. If it ends early, the first window is
        tried: where that ends, every window over the same words is unique. The rest is halved.
        """
        marks = np.zeros(len(self.text) + 1, bool)
        lengths = np.diff(np.r_[self.starts, len(self.text)]) - 1
        first = self.starts[sequence]
        last = first + lengths[sequence] - width
        first, last = first[last >= first], last[last >= first]
        while len(first):
            # whole ranges
            end = np.minimum(last, first + width)
            rest = end < last
            queued = [(end[rest] + 1, last[rest])]
            failed = self.extend(end + width - 1, first)
            sure = np.maximum(failed + 1, first)
            self._mark(marks, sure, end)
            open_ = sure > first
            a, b = first[open_], np.minimum(failed[open_], end[open_])
            b -= b == end[open_]  # the last window holds the words that failed
            a, b = a[b >= a], b[b >= a]
            # first windows
            failed = self.extend(a + width - 1, a)
            found = failed < a
            marks[a[found]] = True
            a = np.where(found, a + 1, failed + 1)
            a, b = a[a <= b], b[a <= b]
            middle = (a + b) // 2
            queued += [(a, middle), (middle[middle < b] + 1, b[middle < b])]
            first, last = (np.concatenate(x) for x in zip(*queued))
        return marks[:-1]

    @staticmethod
    def _mark(marks: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        ok = first <= last
        change = np.zeros(len(marks), np.int32)
        np.add.at(change, first[ok], 1)
        np.add.at(change, last[ok] + 1, -1)
        marks |= change.cumsum() > 0
