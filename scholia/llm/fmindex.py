"""An FM-index over numbers: suffix order, wavelet matrix, sampled positions, all in numpy."""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence that ends in 0. Each 0 is a separator of its own, smaller the earlier, so that no comparison passes one."""
    n = len(seq)
    sep = seq == 0
    k = int(sep.sum())
    rank = seq.astype(np.int64) + k
    rank[sep] = np.arange(k)
    _, rank = np.unique(rank, return_inverse=True)
    rank = rank.astype(np.int64)
    h = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1 if h < n else 0
        key = rank * (n + 1) + nxt
        sa = np.argsort(key, kind="stable")
        new = np.empty(n, bool)
        new[0] = False
        ks = key[sa]
        np.not_equal(ks[1:], ks[:-1], out=new[1:])
        r = np.cumsum(new)
        rank = np.empty(n, np.int64)
        rank[sa] = r
        if r[-1] == n - 1 or h >= n:
            return sa
        h *= 2


class WaveletMatrix:
    """rank(c, i): how often c stands among the first i symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = symbols
        for level in range(bits - 1, -1, -1):
            b = (s >> level) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            up = b.astype(bool)
            s = np.concatenate([s[~up], s[up]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, at = np.zeros_like(i), i
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            up = ((c >> level) & 1).astype(bool)
            ones, z = self.ones[k], self.zeros[k]
            r, r0 = ones[at], ones[lo]
            at = np.where(up, z + r, at - r)
            lo = np.where(up, z + r0, lo - r0)
        return at - lo


class FMIndex:
    """Backward search and locate for patterns without 0."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 8):
        self.n = len(seq)
        sa = suffix_order(seq)
        self.bwt = seq[sa - 1].astype(np.int64)
        self.bwt[sa == 0] = 0
        self.c = np.zeros(sigma + 1, np.int64)
        self.c[1:] = np.cumsum(np.bincount(seq, minlength=sigma))
        self.tree = WaveletMatrix(self.bwt, max(1, int(sigma - 1).bit_length()))
        # every sample-th position is kept, and each that follows a separator
        self.kept = (sa % sample == 0) | (self.bwt == 0)
        self.slot = np.cumsum(self.kept) - 1
        self.samples = sa[self.kept]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern number, first row, end) of the patterns that occur; patterns: one a row, all of one length."""
        which = np.arange(len(patterns))
        last = patterns[:, -1]
        lo, hi = self.c[last], self.c[last + 1]
        for j in range(patterns.shape[1] - 2, -2, -1):
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
            if j < 0 or not len(which):
                break
            c = patterns[which, j]
            lo, hi = self.c[c] + self.tree.rank(c, lo), self.c[c] + self.tree.rank(c, hi)
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled one."""
        out, at = np.zeros(len(rows), np.int64), rows.copy()
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            r = at[todo]
            done = self.kept[r]
            out[todo[done]] = self.samples[self.slot[r[done]]] + steps
            todo, r = todo[~done], r[~done]
            c = self.bwt[r]
            at[todo] = self.c[c] + self.tree.rank(c, r)
            steps += 1
        return out
