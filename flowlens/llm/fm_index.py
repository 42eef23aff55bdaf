"""An FM-index over integer symbols: suffix array, wavelet tree, backward search, located rows."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start places of the suffixes in order, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - width] = rank[width:] if width < n else rank[:0]
        key = rank * (n + 1) + (ahead + 1)
        order = np.argsort(key, kind="stable")
        steps = np.zeros(n, np.int64)
        steps[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        width *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, one row of bits per binary digit of the alphabet."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int64))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(place), place.copy()
        for row, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            ones = self.ones[row]
            low = np.where(one, self.zeros[row] + ones[low], low - ones[low])
            high = np.where(one, self.zeros[row] + ones[high], high - ones[high])
        return high - low

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before that place."""
        symbol, low, at = np.zeros_like(place), np.zeros_like(place), place.copy()
        for row in range(self.bits):
            ones = self.ones[row]
            one = (ones[at + 1] - ones[at]).astype(bool)
            symbol = symbol * 2 + one
            low = np.where(one, self.zeros[row] + ones[low], low - ones[low])
            at = np.where(one, self.zeros[row] + ones[at], at - ones[at])
        return symbol, at - low


class FmIndex:
    """Symbols are integers from 1; the index adds the end mark 0."""

    def __init__(self, symbols: np.ndarray, sample: int = 4):
        text = np.r_[symbols, 0].astype(np.int64)
        order = suffix_array(text)
        last = text[order - 1]
        self.n, self.top = len(text), int(text.max(initial=0))
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=self.top + 1))]
        self.tree = WaveletTree(last, self.top)
        kept = order % sample == 0
        self.kept = np.r_[0, np.cumsum(kept)]
        self.places = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each row of ``patterns``."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for symbol in patterns.T[::-1]:
            known = (symbol > 0) & (symbol <= self.top)
            use = np.where(known, symbol, 0)
            low, high = (np.where(known, self.first[use] + self.tree.rank(use, x), 0) for x in (low, high))
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row's suffix: walk back to the nearest sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        found = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            stored = self.kept[at + 1] > self.kept[at]
            done = open_[stored]
            found[done] = self.places[self.kept[at[stored]]] + steps[done]
            open_ = open_[~stored]
            symbol, before = self.tree.access(rows[open_])
            rows[open_] = self.first[symbol] + before
            steps[open_] += 1
        return found
