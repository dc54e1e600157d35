"""FM-index over word numbers: suffix array, wavelet matrix, backward search and location."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of `s` in order; the last symbol is 0 and occurs once.

    The first sort compares as many symbols as fit into 63 bits. Then prefixes double, and only
    suffixes that still tie with a neighbour are sorted again.
    """
    n, bits = len(s), max(1, int(s.max()).bit_length())
    span = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([s, np.zeros(span, np.int64)])
    for j in range(span):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    alone = fresh & np.concatenate([fresh[1:], [True]])
    tied = np.flatnonzero(~alone)
    while len(tied):
        at = order[tied]
        behind = at + span
        key = rank[at] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[at] = place
        alone = fresh & np.concatenate([fresh[1:], [True]])
        tied = tied[~alone]
        span *= 2
    return order


class WaveletMatrix:
    """Ranks in a sequence of numbers, one bit a level, highest first."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.n = bits, len(s)
        self.zeros, self.split = [], []
        for level in range(bits - 1, -1, -1):
            bit = (s >> level) & 1
            zeros = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit == 0, out=zeros[1:])
            self.zeros.append(zeros)
            self.split.append(int(zeros[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def walk(self, symbols: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """Where the prefixes of lengths `at` end in the symbols' block of the last level."""
        at = list(at)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one, zeros = ((symbols >> level) & 1).astype(bool), self.zeros[k]
            for j, i in enumerate(at):
                before = zeros[i]
                at[j] = np.where(one, self.split[k] + i - before, before)
        return at

    def rank(self, symbols: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs in the prefixes of lengths `at`."""
        start, *ends = self.walk(symbols, np.zeros(len(symbols), np.int64), *at)
        return [e - start for e in ends]


class FMIndex:
    """Index of a sequence of numbers from 1 on. Keeps the BWT's wavelet matrix and every `sample`-th position."""

    def __init__(self, numbers: np.ndarray, sample: int = 8):
        s = np.concatenate([numbers.astype(np.int64), [0]])
        order = suffix_array(s)
        bwt = s[order - 1]
        top = int(s.max())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        self.matrix = WaveletMatrix(bwt, max(1, top.bit_length()))
        self.bwt = bwt.astype(np.int32)
        self.known = order % sample == 0
        self.known_rank = np.concatenate([[0], np.cumsum(self.known)])
        self.samples = order[self.known]
        self.n, self.top = len(s), top

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases: rows of numbers, aligned at the right, 0 before them."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1] if len(phrases) else 0
        for back in range(1, width + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            if not len(on):
                break
            symbols = phrases[on, width - back]
            first, last = self.matrix.rank(symbols, low[on], high[on])
            low[on], high[on] = self.less[symbols] + first, self.less[symbols] + last
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled position."""
        found = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(left):
            here = self.known[rows]
            found[left[here]] = self.samples[self.known_rank[rows[here]]] + steps
            left, rows = left[~here], rows[~here]
            if len(left):
                symbols = self.bwt[rows].astype(np.int64)
                rows = self.less[symbols] + self.matrix.rank(symbols, rows)[0]
            steps += 1
        return found
