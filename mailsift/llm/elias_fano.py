"""Elias-Fano sequences and an n-gram trie over them, as files that are mapped."""

from __future__ import annotations

import struct

import numpy as np

from . import blobs

#: Words of 64 bits in one entry of a select directory.
STRIDE = 8


def _zeros(words: np.ndarray) -> np.ndarray:
    """Zero bits before each stride of words."""
    ones = np.bitwise_count(words).astype(np.int64)
    full = 64 * len(words)
    ends = np.cumsum(64 - ones)[STRIDE - 1 :: STRIDE]
    return np.concatenate([[0], ends]) if full else np.zeros(1, np.int64)


class EliasFano:
    """A non-decreasing sequence of unsigned integers.

    The low bits are packed side by side; the high parts are written in unary (a
    one for each element, a zero where the high part steps up). ``get`` selects
    ones, ``next_geq`` selects zeros, which bounds the search to the elements that
    share the high part. All operations take arrays."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, low_bits, low, high
        self._zero_directory = _zeros(high)
        at = np.arange(len(self._zero_directory), dtype=np.int64) * 64 * STRIDE
        self._one_directory = np.minimum(at, 64 * len(high)) - self._zero_directory

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
        if low_bits and n:
            part = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            spill = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (np.uint64(64) - shift[spill]))
        steps = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = n + (int(steps[-1]) if n else 0) + 1
        flags = np.zeros((bits + 63) // 64 * 64, np.uint8)
        flags[steps + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8").astype(np.uint64)
        return cls(n, universe, low_bits, low, high)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        """Position of the k-th one (``flip``: zero), from 0."""
        stride = np.searchsorted(directory, k, side="right") - 1
        left = k - directory[stride]
        word = stride * STRIDE
        for _ in range(STRIDE - 1):
            inside = np.minimum(word, len(self.high) - 1)
            bits = self.high[inside]
            have = np.bitwise_count(~bits if flip else bits).astype(np.int64)
            go = (left >= have) & (word == inside)
            left = left - np.where(go, have, 0)
            word = word + go
        inside = np.minimum(word, len(self.high) - 1)
        bits = ~self.high[inside] if flip else self.high[inside]
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = (bits >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)
            have = np.bitwise_count(part).astype(np.int64)
            go = left >= have
            left = left - np.where(go, have, 0)
            at = at + np.where(go, width, 0)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select(i, self._one_directory, False) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(i)

    def next_geq(self, x: np.ndarray) -> np.ndarray:
        """Position of the first element >= x (n if there is none)."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        beyond = x >= np.uint64(self.universe)
        x = np.where(beyond, np.uint64(0), x)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), self._zero_directory, True) - (high - 1), 0)
        end = self._select(high, self._zero_directory, True) - high
        low = x & np.uint64((1 << self.low_bits) - 1)
        lo, hi = start.copy(), end.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self._lows(mid[open_]) < low[open_]
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return np.where(beyond, self.n, lo)

    def parts(self):
        yield struct.pack("<5Q", self.n, self.universe, self.low_bits, len(self.low), len(self.high))
        yield np.ascontiguousarray(self.low, "<u8").tobytes()
        yield np.ascontiguousarray(self.high, "<u8").tobytes()

    @classmethod
    def read(cls, data, at: int) -> tuple[EliasFano, int]:
        n, universe, low_bits, n_low, n_high = struct.unpack_from("<5Q", memoryview(data), at)
        low = np.frombuffer(data, "<u8", n_low, at + 40)
        high = np.frombuffer(data, "<u8", n_high, at + 40 + 8 * n_low)
        return cls(n, universe, low_bits, low, high), at + 40 + 8 * (n_low + n_high)


#: log10 probabilities are stored as 16-bit steps of this many powers of ten.
LOWEST = 16.0
STEPS = (1 << 16) - 1


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-log10, 0, LOWEST) * (STEPS / LOWEST)).astype("<u2")


def restore(codes: np.ndarray) -> np.ndarray:
    return codes * (-LOWEST / STEPS)


class Trie:
    """Contexts, their successors with codes, and below these any number of further levels.

    A level is monotone pointers from its parents (contexts, or n-grams by their place
    in the level above) and the successors, each stored relative to the last value of
    the parent before, which makes the whole level one monotone sequence."""

    def __init__(self, contexts: EliasFano, levels: list[tuple[EliasFano, EliasFano, np.ndarray]]):
        self.contexts, self.levels = contexts, levels
        self.codes = levels[0][2]

    @classmethod
    def parts(cls, context: np.ndarray, successor: np.ndarray, codes: np.ndarray, *deeper: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """File contents for pairs sorted by context and successor (successors from 1).

        ``deeper`` holds, for each further level, the place of the parent in the level
        above, the successor and the code, sorted by place and successor."""
        names, parent = np.unique(context, return_inverse=True)
        yield b"EFTRIE02" + struct.pack("<Q", 1 + len(deeper))
        yield from EliasFano.build(names).parts()
        parents = len(names)
        for parent, successor, codes in ((parent, successor, codes), *deeper):
            bounds = np.searchsorted(parent, np.arange(parents + 1))
            filled = np.flatnonzero(np.diff(bounds))
            base = np.zeros(parents + 1, np.uint64)
            base[filled + 1] = successor[bounds[filled + 1] - 1]
            np.cumsum(base, out=base)
            for values in (bounds, successor.astype(np.uint64) + base[np.asarray(parent, np.int64)]):
                yield from EliasFano.build(values).parts()
            yield np.ascontiguousarray(codes, "<u2").tobytes() + bytes(-2 * len(codes) % 8)
            parents = len(successor)

    @classmethod
    def open(cls, uri: str) -> Trie:
        data = blobs.mapped(uri)
        if bytes(memoryview(data)[:8]) != b"EFTRIE02":
            raise ValueError(f"{uri} is not a trie")
        (depth,) = struct.unpack_from("<Q", memoryview(data), 8)
        contexts, at = EliasFano.read(data, 16)
        levels = []
        for _ in range(depth):
            pointers, at = EliasFano.read(data, at)
            successors, at = EliasFano.read(data, at)
            levels.append((pointers, successors, np.frombuffer(data, "<u2", successors.n, at)))
            at += (2 * successors.n + 7) // 8 * 8
        return cls(contexts, levels)

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Position of each pair, or -1."""
        if not self.contexts.n:
            return np.full(len(context), -1, np.int64)
        names, like = np.unique(context, return_inverse=True)
        at = self.contexts.next_geq(names)
        known = at < self.contexts.n
        known[known] = self.contexts.get(at[known]) == names[known]
        return self.below(0, np.where(known, at, -1)[like], successor)

    def below(self, level: int, parent: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Position in a level of each successor of a parent (-1: no such parent), or -1."""
        pointers, successors, _ = self.levels[level]
        out = np.full(len(parent), -1, np.int64)
        ask = np.flatnonzero(parent >= 0)
        if not len(ask) or not successors.n:
            return out
        names, of = np.unique(parent[ask], return_inverse=True)
        begin = pointers.get(names).astype(np.int64)
        end = pointers.get(names + 1).astype(np.int64)
        base = np.where(begin > 0, successors.get(np.maximum(begin - 1, 0)), np.uint64(0))
        target = successor[ask].astype(np.uint64) + base[of]
        place = successors.next_geq(target)
        inside = place < end[of]
        inside[inside] = successors.get(place[inside]) == target[inside]
        out[ask[inside]] = place[inside]
        return out
