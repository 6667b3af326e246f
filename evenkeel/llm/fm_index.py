"""A word-level FM-index in numpy: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

END, GAP, FIRST = 0, 1, 2          # the text's end, any word no phrase holds, and the first phrase word


def suffix_order(s: np.ndarray, bits: int) -> np.ndarray:
    """Positions of all suffixes in order. s closes with END, the only one, so no two suffixes are equal.

    As many symbols as fit a 64-bit key are compared at once; only ties are refined, doubling the depth."""
    n, per = len(s), max(1, 63 // bits)
    key = s.astype(np.int64)
    for j in range(1, per):
        key <<= bits
        if j < n:
            key[: n - j] |= s[j:]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    depth = per
    while len(at):
        tied = order[at]
        after = tied + depth
        key = rank[tied] << 32 | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        o = np.argsort(key)
        tied, key = tied[o], key[o]
        order[at] = tied
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[tied] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~(new & np.concatenate((new[1:], [True])))]
        depth *= 2
    return order


class Bits:
    """A bit vector with rank: packed words and the ones before each word."""

    def __init__(self, flags: np.ndarray):
        words = np.zeros((len(flags) // 64 + 1) * 64, bool)
        words[: len(flags)] = flags
        self.words = np.packbits(words, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1]))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1))).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Counts and places phrases in a text of word symbols (FIRST and above; GAP matches nothing)."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 8):
        s = np.concatenate((symbols, [END])).astype(np.int64)
        self.n, self.bits = len(s), max(1, int(alphabet - 1).bit_length())
        order = suffix_order(s, self.bits)
        counts = np.bincount(s, minlength=alphabet)
        self.less = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.levels, self.zeros = [], []
        rest = s[order - 1]
        for level in range(self.bits - 1, -1, -1):
            ones = (rest >> level) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(rest) - ones.sum()))
            rest = np.concatenate((rest[~ones], rest[ones]))
        starts = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1])))
        self.first = np.zeros(alphabet, np.int64)          # where a symbol's run begins on the last level
        self.first[rest[starts]] = starts
        marked = order % sample == 0
        self.marked, self.sampled = Bits(marked), order[marked]

    def _rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before row i of the last column."""
        for level, bits, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where((c >> level) & 1 == 1, zeros + ones, i - ones)
        return i - self.first[c]

    def _back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one word earlier."""
        i, c = row, np.zeros(len(row), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(i), bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
            c = c << 1 | one
        return self.less[c] + i - self.first[c]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of phrases (right-aligned symbols, one per line), all searched backwards together."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - step]
            lo[live] = self.less[c] + self._rank(c, lo[live])
            hi[live] = self.less[c] + self._rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to a sampled suffix, at most sample - 1 times."""
        out, steps = np.empty(len(rows), np.int64), 0
        where, row = np.arange(len(rows)), rows
        while len(where):
            done = self.marked.get(row)
            out[where[done]] = self.sampled[self.marked.rank(row[done])] + steps
            where, row = where[~done], row[~done]
            row = self._back(row) if len(row) else row
            steps += 1
        return out
