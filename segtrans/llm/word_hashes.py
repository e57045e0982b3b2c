"""64-bit hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED = 300_000  # words; a cache starts afresh beyond
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
LONG = 1024  # bytes of a word
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordHashes(dict):
    """Hash by word, computed once per worker and word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(32))


def split_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, in order, and the number of words of each text.

    Words are what ``bytes.split`` finds. All words take their next eight bytes
    at once, so the passes are as many as the longest of them has such pieces;
    the few beyond ``LONG`` bytes are hashed one by one.
    """
    data = b"\n" + b"\n".join(texts) + b"\n"
    data += bytes(16 - len(data) % 8)
    places, eights = np.frombuffer(data, np.uint8), np.frombuffer(data, "<u8")
    places = places[:sum(map(len, texts)) + len(texts) + 1]
    space = (places == 32) | (places - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    hashes = mixed(lengths.astype(np.uint64) * BASE)
    active, at, left = np.flatnonzero(lengths <= LONG), starts, lengths
    at, left = at[active], left[active]
    while len(active):
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        piece = eights[word] >> shift | eights[word + 1] << np.uint64(1) << np.uint64(63) - shift
        hashes[active] = mixed(hashes[active] ^ piece & FIRST_BYTES[np.minimum(left, 8)])
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > LONG):
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + lengths[i]])
    ends = np.cumsum([len(text) + 1 for text in texts])
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words: a polynomial, then mixed."""
    n = len(hashes) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(length))
    for i in range(length):
        out = out * BASE + hashes[i:i + n]
    return mixed(out)


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def long_runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """As ``runs``, in time that does not depend on ``length``: differences of running sums.

    The sum of h[j] * B**j over a run, times B**(n - start), is the same wherever
    the run lies in a text of n words if n is a constant; the inverse power of B
    makes it so for any text.
    """
    n = len(hashes) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes))[:-1], out=sums[1:])
    back = np.full(n, inverse)
    back[0] = 1
    return mixed((sums[length:] - sums[:-length]) * np.multiply.accumulate(back))
