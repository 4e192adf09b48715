"""A full-text index over sequences of integer symbols: suffix array, Burrows-Wheeler transform, backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; ``text`` holds symbols of 0 and above."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[: n - k] = rank[k:] if k < n else 0
        order = np.lexsort((ahead, rank))
        fresh = np.ones(n, dtype=np.int64)
        fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(fresh) - 1
        rank = new
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class FmIndex:
    """Compressed index of many sequences. Symbols are 0 .. sigma-1; rows are found by backward search.

    It keeps the transform as 32-bit symbols, the rows of each symbol in order (a rank is one binary
    search among them), and of every SAMPLE-th place of the text the sequence it lies in; other rows
    walk back to such a place. Neither the text nor its suffix array is kept.
    """

    SAMPLE = 4

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, sigma: int):
        n_seq = len(offsets) - 1
        lengths = np.diff(offsets)
        # a separator (0) goes before every sequence, symbols move up by one
        text = np.zeros(len(symbols) + n_seq, dtype=np.int32)
        text[np.arange(len(symbols)) + np.repeat(np.arange(n_seq), lengths) + 1] = symbols + 1
        owner = np.repeat(np.arange(n_seq, dtype=np.int32), lengths + 1)
        sa = suffix_array(text)
        self.n = len(text)
        self.bwt = text[sa - 1] if self.n else text
        self.first = np.zeros(sigma + 2, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=sigma + 1), out=self.first[1:])
        self.rows = np.argsort(self.bwt, kind="stable").astype(np.int32)
        # separators are places of the sample, so no walk leaves its sequence
        kept = (sa % self.SAMPLE == 0) | (text[sa] == 0)
        self.before = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)]).astype(np.int32)
        self.sample = owner[sa[kept]]

    def _rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Place of the first row of ``symbol`` at or after ``row`` among all rows ordered by symbol."""
        lo, hi = self.first[symbol].copy(), self.first[symbol + 1].copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            less = open_ & (self.rows[np.minimum(mid, self.n - 1)] < row)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of single symbols; negative symbols occur nowhere."""
        known = symbol >= 0
        s = np.where(known, symbol + 1, 0)
        return np.where(known, self.first[s], 0), np.where(known, self.first[s + 1], 0)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: ranges of ``symbol`` followed by what the ranges stand for."""
        known = symbol >= 0
        s = np.where(known, symbol + 1, 0)
        return np.where(known, self._rank(s, lo), 0), np.where(known, self._rank(s, hi), 0)

    def maximal_matches(self, symbols: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All matches that end at the places ``ends`` of the patterns and cannot go further back.

        ``begin`` is the first place of the pattern that each end belongs to. Returns for every match
        the index of its end, the sequence it lies in, and its length. Each step of backward search
        keeps of an end's rows those that the next symbol stands before; the others' matches stop there.
        """
        lo, hi = self.start(symbols[ends])
        count = hi - lo
        which = np.repeat(np.arange(len(ends)), count)
        row = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        length = np.ones(len(which), dtype=np.int32)
        found = which, self.locate(row), length
        match, back = np.arange(len(which)), 1
        while len(match):
            on = ends[which] - back >= begin[which]
            ahead = symbols[ends[which[on]] - back]
            on[on] = (self.bwt[row[on]] == ahead + 1) & (ahead >= 0)
            match, which = match[on], which[on]
            if not len(match):
                break
            alive = np.unique(which)
            # of one end all rows are one range, and a step keeps their order
            lo[alive], hi[alive] = self.extend(lo[alive], hi[alive], symbols[ends[alive] - back])
            size = np.bincount(which, minlength=len(ends))[alive]
            row = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[alive], size)
            length[match] += 1
            back += 1
        return found

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The sequence of every row: rows walk back to a place of the sample."""
        out = np.full(len(row), -1, dtype=np.int64)
        left, at = np.arange(len(row)), row.astype(np.int64)
        while len(left):
            kept = self.before[at + 1] > self.before[at]
            out[left[kept]] = self.sample[self.before[at[kept]]]
            left, at = left[~kept], at[~kept]
            at = self._rank(self.bwt[at].astype(np.int64), at)
        return out
