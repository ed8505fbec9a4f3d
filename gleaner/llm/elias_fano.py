"""Elias-Fano coded monotone sequences on flat arrays, with look-ups for many keys at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_STEP = 1 << 14            # look-ups made together: 64 bytes of bits each


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after the other, in 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 2, dtype=U64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, off = at >> 6, (at & 63).astype(U64)
        np.bitwise_or.at(out, word, values << off)
        over = np.flatnonzero(off + U64(width) > U64(64))
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (U64(64) - off[over]))
    return out


class EliasFano:
    """An ascending sequence of distinct numbers below ``universe``: low bits are stored as they are, high
    bits in unary. ``zeros`` counts the zero bits before each word of the unary part."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max((universe // max(n, 1)).bit_length() - 1, 0)
        values = values.astype(U64)
        low = _pack(values & U64((1 << width) - 1), width)
        tops = (values >> U64(width)).astype(np.int64)
        bits = np.zeros((n + (universe >> width) + 2 + 63) // 64 * 64, dtype=np.uint8)
        bits[tops + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        ones = bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        zeros = np.concatenate(([0], np.cumsum(64 - ones)[:-1])).astype(np.int64) if len(ones) else np.zeros(1, dtype=np.int64)
        return cls(n, width, low, high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], dtype=np.int64), self.low, self.high, self.zeros]

    @classmethod
    def of(cls, arrays: Iterator[np.ndarray]) -> EliasFano:
        n, width = next(arrays).tolist()
        return cls(n, width, next(arrays), next(arrays), next(arrays))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if self.width == 0:
            return np.zeros(len(at), dtype=U64)
        bit = at * self.width
        word, off = bit >> 6, (bit & 63).astype(U64)
        over = np.where(off > 0, self.low[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
        return ((self.low[word] >> off) | over) & U64((1 << self.width) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero bit (from 0) of the unary part."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        bits = np.unpackbits(np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rank = np.cumsum(1 - bits, axis=1, dtype=np.uint8)
        return word * 64 + np.argmax(rank == (k - self.zeros[word] + 1).astype(np.uint8)[:, None], axis=1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers (from 0) of the sequence, which may repeat numbers."""
        out = np.zeros(len(i), dtype=np.int64)
        for a in range(0, len(i), _STEP):
            part = i[a:a + _STEP]
            # The last word with at most i ones before it holds the i-th one.
            low, high = np.zeros(len(part), dtype=np.int64), np.full(len(part), len(self.zeros), dtype=np.int64)
            while (high - low > 1).any():
                mid = (low + high) >> 1
                less = 64 * mid - self.zeros[mid] <= part
                low, high = np.where(less, mid, low), np.where(less, high, mid)
            bits = np.unpackbits(np.ascontiguousarray(self.high[low]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rank = np.cumsum(bits, axis=1, dtype=np.uint8)
            top = low * 64 + np.argmax(rank == (part - 64 * low + self.zeros[low] + 1).astype(np.uint8)[:, None], axis=1) - part
            out[a:a + _STEP] = (top << self.width) | self._lows(part).astype(np.int64)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1: the successor search of the key, kept if it is the key."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for a in range(0, len(keys) if self.n else 0, _STEP):
            part = keys[a:a + _STEP].astype(U64)
            top = (part >> U64(self.width)).astype(np.int64)
            # Numbers with the same high bits lie between two zeros.
            low = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) - np.maximum(top - 1, 0), 0)
            high = self._zero(top) - top
            want, end = part & U64((1 << self.width) - 1), high.copy()
            while (open_ := low < high).any():
                mid = (low + high) >> 1
                less = np.zeros(len(part), dtype=bool)
                less[open_] = self._lows(mid[open_]) < want[open_]
                low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
            hit = low < end
            hit[hit] = self._lows(low[hit]) == want[hit]
            out[a:a + _STEP][hit] = low[hit]
        return out
