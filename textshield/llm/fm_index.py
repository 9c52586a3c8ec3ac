"""An FM-index over sequences of small numbers, searched for many phrases at once.

The Burrows-Wheeler transform lies in a wavelet matrix, whose ranks drive the backward search;
every few positions of the suffix array are kept and the others are found by stepping back.
"""

from __future__ import annotations

import numpy as np

from textshield.llm.blocks import ragged

END, GAP, FIRST = 0, 1, 2
SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes by prefix doubling; gaps differ from each other by position."""
    n = len(symbols)
    gap = symbols == GAP
    rank = symbols.astype(np.int64) + int(gap.sum())
    rank[gap] = 1 + np.arange(int(gap.sum()))
    rank[symbols == END] = 0
    width = 1
    while True:
        next_rank = np.full(n, -1, np.int64)
        if width < n:
            next_rank[:-width] = rank[width:]
        key = rank * (int(rank.max()) + 2) + next_rank + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, rest = levels, symbols
        self.ones, self.zeros, self.bits = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (rest >> level) & 1 == 1
            self.bits.append(bit)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(rest) - int(bit.sum()))
            rest = np.concatenate([rest[~bit], rest[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, high = np.zeros_like(end), end
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            ones_low, ones_high = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + ones_low, low - ones_low)
            high = np.where(one, self.zeros[k] + ones_high, high - ones_high)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.levels):
            bit, ones = self.bits[k][at], self.ones[k][at]
            out = out * 2 + bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out


class FMIndex:
    """Index of one shard: ``runs`` is all sequences in a row, ``lengths`` their lengths; symbols are from 0."""

    def __init__(self, runs: np.ndarray, lengths: np.ndarray, n_symbols: int):
        n = len(runs) + len(lengths)
        symbols = np.full(n + 1, GAP, np.int64)
        run, place = ragged(lengths)
        begin = np.cumsum(lengths + 1) - lengths - 1
        at = begin[run] + place
        symbols[at] = runs + FIRST
        symbols[n] = END
        order = suffix_array(symbols)
        self.source = np.full(n + 1, -1, np.int64)
        self.source[at] = np.arange(len(runs))
        self.wavelet = WaveletMatrix(symbols[order - 1], max(1, int(n_symbols + FIRST - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + FIRST))])
        kept = order % SAMPLE == 0
        kept |= np.isin(order, begin)
        self.kept, self.kept_rank, self.positions = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each phrase; ``phrases`` holds one of equal length per row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.before[-1])
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column] + FIRST
            low = self.before[symbol] + self.wavelet.rank(symbol, low)
            high = self.before[symbol] + self.wavelet.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all suffixes in the ranges: the number of the range and the place in ``runs``."""
        phrase, place = ragged(high - low)
        at = low[phrase] + place
        found, steps, open_ = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        while len(open_):
            here = self.kept[at[open_]]
            done = open_[here]
            found[done] = self.positions[self.kept_rank[at[done]]] + steps[done]
            open_ = open_[~here]
            symbol = self.wavelet.symbol(at[open_])
            at[open_] = self.before[symbol] + self.wavelet.rank(symbol, at[open_])
            steps[open_] += 1
        return phrase, self.source[found]
