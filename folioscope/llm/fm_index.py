"""FM-index over a sequence of small integers: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; a suffix that ends is less than one that goes on."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    rank = text.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    step = 1
    own = rank[order]
    new = np.empty(n, np.int64)
    new[order] = np.cumsum(np.concatenate([[1], own[1:] != own[:-1]]))
    rank = new
    while rank[order[-1]] < n:
        # only suffixes whose rank is shared move
        counts = np.bincount(rank, minlength=n + 1)
        todo = np.flatnonzero(counts[rank] > 1)
        after = np.zeros(len(todo), np.int64)
        inside = todo + step < n
        after[inside] = rank[todo[inside] + step]
        # ranks leave room for those that share one: the first of a class is its count of smaller suffixes
        first = np.cumsum(counts)[rank[todo] - 1]
        at = np.lexsort((after, first))
        first, after, todo = first[at], after[at], todo[at]
        heads = np.concatenate([[True], first[1:] != first[:-1]])
        starts = np.flatnonzero(heads)
        slot = first + np.arange(len(todo)) - np.repeat(starts, np.diff(np.append(starts, len(todo))))
        order[slot] = todo
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (after[1:] != after[:-1])])
        single = np.ones(n, bool)
        single[slot] = fresh
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(single)
        rank = new
        step *= 2
    return order


class WaveletMatrix:
    """Ranks and symbols of a sequence over [0, 2**bits), for many places at once."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        lo, hi = np.zeros(len(end), np.int64), end.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        lo, hi, symbol = np.zeros(len(at), np.int64), at.astype(np.int64), np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            b = ones[hi]
            bit = ones[hi + 1] > b
            a = ones[lo]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
            symbol = 2 * symbol + bit
        return symbol, hi - lo


class FMIndex:
    """Counts and locates phrases in a text; symbols are positive, and phrases never hold the end mark 0."""

    def __init__(self, text: np.ndarray, sample: int = 16):
        text = np.append(text, 0)
        n = self.n = len(text)
        order = suffix_order(text)
        self.bwt = WaveletMatrix(text[order - 1])
        counts = np.bincount(text, minlength=1 << self.bwt.bits)
        self.before = np.cumsum(counts) - counts
        marked = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.positions = order[marked]
        self.symbols = len(counts)
        assert n == len(order)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase (rows, filled up on the right), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            own = np.flatnonzero((k < lengths) & (hi > lo))
            symbol = phrases[own, k]
            known = symbol < self.symbols
            hi[own[~known]] = lo[own[~known]]
            own, symbol = own[known], symbol[known]
            base = self.before[symbol]
            ends = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[own], hi[own]]))
            lo[own], hi[own] = base + ends[: len(own)], base + ends[len(own) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row of the suffix order, by steps back to the nearest sampled one."""
        rows, out = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            found = self.marks[rows + 1] > self.marks[rows]
            out[left[found]] = self.positions[self.marks[rows[found]]] + steps
            left, rows = left[~found], rows[~found]
            symbol, rank = self.bwt.access(rows)
            rows = self.before[symbol] + rank
            steps += 1
        return out
