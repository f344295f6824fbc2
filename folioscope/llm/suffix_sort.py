"""Suffix order of many short byte strings by hash-compared merge sort.

Prefix polynomial hashes make two substrings comparable in one step, so that a binary search over lengths finds how far
two suffixes agree, and the next byte decides their order: a comparison takes logarithmic time. All comparisons
of a level of the merge sort are made at once, over all buckets.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """1, base, base squared and so on, modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def prefix_hashes(rows: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """For rows of bytes, the polynomial hashes of their prefixes; each byte counts as one more than its value."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * powers(rows.shape[1], base), axis=1, out=out[:, 1:])
    return out


class Suffixes:
    """Suffixes (row, offset) of rows of bytes, compared up to ``depth`` bytes; both of a comparison have one offset."""

    def __init__(self, rows: np.ndarray, depth: int):
        self.rows, self.depth, self.width = rows, depth, rows.shape[1] + 1
        self.hashes = prefix_hashes(rows).ravel()
        self.bytes = rows.ravel()

    def agree(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Whether n bytes from the offset have the same hash in the two rows."""
        a, b = x * self.width + at, y * self.width + at
        h = self.hashes
        return h[a + n] - h[a] == h[b + n] - h[b]

    def common(self, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many bytes two suffixes share, ``depth`` at most."""
        out = np.full(len(x), self.depth, np.int64)
        left = np.flatnonzero(~self.agree(x, y, at, self.depth))
        lo, hi = np.zeros(len(left), np.int64), np.full(len(left), self.depth - 1, np.int64)
        x, y, at = x[left], y[left], at[left]
        for _ in range(int(self.depth).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.agree(x, y, at, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[left] = lo
        return out

    def less(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the first suffix comes before the second; equal ones are ``ties``."""
        n = self.common(x, y, at)
        out = ties.copy()
        own = np.flatnonzero(n < self.depth)
        step = self.rows.shape[1]
        spot = at[own] + n[own]
        out[own] = self.bytes[x[own] * step + spot] < self.bytes[y[own] * step + spot]
        return out

    def sort(self, row: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """An order of the suffixes by bucket and then by their bytes; the suffixes of a bucket share an offset."""
        order = np.argsort(bucket, kind="stable")
        own = bucket[order]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
        size = np.diff(np.append(heads, len(own)))
        start, size = np.repeat(heads, size), np.repeat(size, size)
        width, most = 1, int(size.max(initial=0))
        while width < most:
            moving = np.flatnonzero(size > width)
            first, total = start[moving], size[moving]
            place = moving - first
            run = place // width
            other = (run ^ 1) * width
            lo, hi = np.minimum(other, total), np.minimum(other + width, total)
            base = lo.copy()
            late = (run & 1).astype(bool)  # of equal suffixes, those of the earlier run come first
            x, offset = row[order[moving]], at[order[moving]]
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                y = row[order[first[open_] + mid]]
                before = self.less(y, x[open_], offset[open_], late[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            target = first + (run & ~1) * width + place % width + (lo - base)
            fresh = order.copy()
            fresh[target] = order[moving]
            order = fresh
            width *= 2
        return order

    def repeated(self, row: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Which suffixes agree with another of their bucket in all ``depth`` bytes: with a neighbour in suffix order.

        Agreement of hashes is verified on the bytes; should one fail, the bucket is compared by its bytes alone.
        """
        out = np.zeros(len(row), bool)
        if not len(row):
            return out
        order = self.sort(row, at, bucket)
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(bucket[a] == bucket[b])
        near = near[self.agree(row[a[near]], row[b[near]], at[a[near]], self.depth)]
        a, b = a[near], b[near]
        pair, which = np.unique(row[a] * len(self.rows) + row[b], return_inverse=True)
        sound = np.ones(len(a), bool)
        for lo in range(0, len(pair), 4096):
            x, y = np.divmod(pair[lo : lo + 4096], len(self.rows))
            wrong = np.zeros((len(x), self.width), np.int32)
            np.cumsum(self.rows[x] != self.rows[y], axis=1, out=wrong[:, 1:])
            own = np.flatnonzero((which >= lo) & (which < lo + 4096))
            k = which[own] - lo
            sound[own] = wrong[k, at[a[own]] + self.depth] == wrong[k, at[a[own]]]
        out[a[sound]] = out[b[sound]] = True
        for k in np.unique(bucket[a[~sound]]):
            own = np.flatnonzero(bucket == k)
            raw = [self.rows[row[i], at[i] : at[i] + self.depth].tobytes() for i in own]
            out[own] = [raw.count(x) > 1 for x in raw]
        return out
