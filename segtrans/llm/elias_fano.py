"""Monotone sequences in Elias-Fano form, read from memory-mapped arrays.

A sorted sequence is split into low bits, packed, and high bits, in unary: for
each value of the high part a zero, after a one for each of its members. All
reads are vectorised over many queries.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
ONE, SIX, WORD_BITS = U64(1), U64(6), U64(64)
# Places of the set bits of each byte, eight to a byte.
IN_BYTE = np.array([([at for at in range(8) if byte >> at & 1] + [0] * 8)[:8] for byte in range(256)], np.int64).reshape(-1)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits, one after the other, in 64-bit words (and one to spare)."""
    words = np.zeros((len(values) * width >> 6) + 2, U64)
    if len(values) and width:
        at = np.arange(len(values), dtype=U64) * U64(width)
        word, shift = (at >> SIX).astype(np.int64), at & U64(63)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.add.reduceat(values << shift, first)  # bits never meet: a sum is an or
        over = (shift + U64(width)) > WORD_BITS
        words[word[over] + 1] |= values[over] >> (WORD_BITS - shift[over])
    return words


def _unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), U64)
    bit = at.astype(U64) * U64(width)
    word, shift = (bit >> SIX).astype(np.int64), bit & U64(63)
    value = words[word] >> shift
    over = shift > 0
    value[over] |= words[word[over] + 1] << (WORD_BITS - shift[over])
    return value & ((ONE << U64(width)) - ONE)


def _nth_set(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th (from 0) set bit of each word, by halving down to a byte."""
    word, n, at = word.copy(), n.astype(np.int64), np.zeros(len(word), np.int64)
    for half in (32, 16, 8):
        count = np.bitwise_count(word & ((ONE << U64(half)) - ONE)).astype(np.int64)
        up = n >= count
        n -= np.where(up, count, 0)
        at += np.where(up, half, 0)
        word >>= np.where(up, half, 0).astype(U64)
    return at + IN_BYTE[(word & U64(255)).astype(np.int64) << 3 | n]


class EliasFano:
    """``arrays`` holds what ``encode`` made; they may be memory-mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width, self.buckets = (int(x) for x in arrays["shape"])
        self.low, self.high = arrays["low"], arrays["high"]
        self.ones = arrays["ones"]  # set bits before each word of ``high``
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        """``values``: sorted, unsigned 64-bit."""
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = values >> U64(width)
        buckets = (int(high[-1]) if n else 0) + 1
        bits = np.zeros((n + buckets + 64 >> 6) << 6, np.uint8)
        bits[high.astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(U64)
        ones = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=ones[1:])
        return {"shape": np.array([n, width, buckets], np.int64),
                "low": _pack(values & ((ONE << U64(width)) - ONE), width), "high": words, "ones": ones}

    def _begin(self, bucket: np.ndarray) -> np.ndarray:
        """Number of members before each bucket: the ones before the zero that ends the bucket before."""
        nth = bucket.astype(np.int64) - 1
        inner = nth >= 0
        want = np.where(inner, nth, 0)
        word = np.searchsorted(self.zeros, want, side="right") - 1
        place = _nth_set(~self.high[word], want - self.zeros[word])
        return np.where(inner, word * 64 + place - want, 0)

    def _search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first member not below each key (``n`` if none), and whether it is the key."""
        high = keys >> U64(self.width)
        inside = high < U64(self.buckets)
        bucket = np.where(inside, high, U64(0)).astype(np.int64)
        low, end = self._begin(bucket), self._begin(bucket + 1)
        want = keys & ((ONE << U64(self.width)) - ONE)
        last = end.copy()
        active = np.flatnonzero(low < end)
        while len(active):
            middle = (low[active] + end[active]) >> 1
            below = _unpack(self.low, self.width, middle) < want[active]
            low[active[below]] = middle[below] + 1
            end[active[~below]] = middle[~below]
            active = active[low[active] < end[active]]
        there = inside & (low < last)
        there[there] = _unpack(self.low, self.width, low[there]) == want[there]
        return np.where(inside, low, self.n), there

    def successor(self, keys: np.ndarray) -> np.ndarray:
        return self._search(keys)[0]

    def get(self, at: np.ndarray) -> np.ndarray:
        """Members by index."""
        word = np.searchsorted(self.ones, at, side="right") - 1
        place = word * 64 + _nth_set(self.high[word], at - self.ones[word])
        return ((place - at).astype(U64) << U64(self.width)) | _unpack(self.low, self.width, at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it is no member."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        at, there = self._search(keys)
        return np.where(there, at, -1)
