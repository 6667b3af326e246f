"""Monotone integer sequences in Elias-Fano form, and an n-gram trie level laid out in one flat image."""

from __future__ import annotations

import numpy as np

WINDOW = 1 << 16                  # values decoded at once while searching


class EliasFano:
    """A non-decreasing sequence below a universe: low bits packed, high bits in unary; about 2 + log(u/n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(ones[-1]) // 64 + 1) * 64 if n else 64, bool)
        flags[ones] = True
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))
        return cls(n, bits, low, high, before)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high]

    @classmethod
    def mapped(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray) -> "EliasFano":
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))
        return cls(int(head[0]), int(head[1]), low, high, before)

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a to b, decoded: the ones of the high part from the word that holds the a-th one."""
        b = min(b, self.n)
        if a >= b:
            return np.zeros(0, np.uint64)
        first = int(np.searchsorted(self.before, a, "right")) - 1
        last = int(np.searchsorted(self.before, b, "left"))
        flags = np.unpackbits(self.high[first:last].view(np.uint8), bitorder="little")
        ones = np.flatnonzero(flags)[a - int(self.before[first]):b - int(self.before[first])] + first * 64
        index = np.arange(a, b)
        out = (ones - index).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = index.astype(np.uint64) * np.uint64(self.low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = self.low[word] >> shift
            spill = shift > np.uint64(0)
            part[spill] |= self.low[word[spill] + 1] << (np.uint64(64) - shift[spill])
            out |= part & np.uint64((1 << self.low_bits) - 1)
        return out

    def next_geq(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted wanted values: the index of the first value not below each, and whether it equals it."""
        wanted = np.ascontiguousarray(wanted, np.uint64)
        index, equal, done = np.full(len(wanted), self.n, np.int64), np.zeros(len(wanted), bool), 0
        for a in range(0, self.n, WINDOW):
            if done == len(wanted):
                break
            values = self.slice(a, a + WINDOW)
            stop = int(np.searchsorted(wanted, values[-1], "right"))
            if stop > done:
                at = np.searchsorted(values, wanted[done:stop], "left")
                index[done:stop] = a + at
                equal[done:stop] = values[at] == wanted[done:stop]
                done = stop
        return index, equal


class TrieShard:
    """Contexts, their successors and quantised smoothed probabilities, as views of one flat image.

    Level one: the contexts' keys and pointers, both monotone. Level two: each context's successors, sorted; to be
    monotone over all contexts each is stored above the last value of the context before it, so that a successor is
    searched relative to its context: next_geq(base of the context + successor).
    """

    def __init__(self, image: bytes):
        head = np.frombuffer(image, np.int64, 1)
        ends = np.frombuffer(image, np.int64, int(head[0]), 8)
        at, parts = 8 + 8 * int(head[0]), []
        for k, size in enumerate(ends):
            kind = np.int64 if k in (0, 3, 6, 9) else np.uint8 if k >= 12 else np.uint64
            parts.append(np.frombuffer(image, kind, int(size) // np.dtype(kind).itemsize, at))
            at += -(-int(size) // 8) * 8
        self.keys, self.pointers, self.base, self.successors = (EliasFano.mapped(*parts[k:k + 3]) for k in (0, 3, 6, 9))
        self.codes = parts[12]

    @staticmethod
    def build(keys: np.ndarray, pointers: np.ndarray, successors: np.ndarray, codes: np.ndarray) -> bytes:
        """keys: sorted contexts; pointers: where each one's successors begin, and the end; codes: one byte each."""
        last = successors[pointers[1:] - 1] + 1
        base = np.concatenate(([0], np.cumsum(last)[:-1]))
        relative = successors + np.repeat(base, np.diff(pointers))
        sections = [a for e in (keys, pointers, base, relative) for a in EliasFano.of(e).arrays()] + [codes.astype(np.uint8)]
        sizes = np.array([a.nbytes for a in sections], np.int64)
        body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in sections)
        return np.array([len(sections)], np.int64).tobytes() + sizes.tobytes() + body

    def contexts(self, keys: np.ndarray) -> np.ndarray:
        """The context number of each sorted key, -1 where there is none."""
        index, found = self.keys.next_geq(keys)
        return np.where(found, index, -1)

    def search(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The code of each (context number, successor), both sorted, -1 where the successor is not there."""
        base = self.base.slice(0, self.base.n)
        room = np.append(base[1:], self.successors.slice(self.successors.n - 1, self.successors.n) + np.uint64(1)) - base
        wanted = successor.astype(np.uint64)
        inside = np.flatnonzero(wanted < room[context])     # beyond its context's last successor there is nothing to find
        index, found = self.successors.next_geq(base[context[inside]] + wanted[inside])
        out = np.full(len(wanted), -1, np.int64)
        out[inside[found]] = self.codes[index[found]]
        return out
