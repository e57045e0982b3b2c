"""A tree as balanced parentheses, with a range min-max index over blocks of excess.

A node is an opening bit (1), its children, and a closing bit (0), in preorder;
the excess at a place is the number of nodes open there. Bits are packed into
64-bit words, a word is a block, and a binary tree over the blocks holds the
least excess of each range. All queries take arrays of places.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class BalancedParens:
    def __init__(self, bits: np.ndarray):
        """``bits``: 1 and 0 as uint8, balanced."""
        self.n = len(bits)
        padded = np.zeros(-(-self.n // 64) * 64, np.uint8)
        padded[:self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").astype(U64)
        following = np.r_[self.words[1:], U64(0)]
        # An opening bit with a closing one behind it is a leaf; past the end there is no bit.
        self.leaf_words = self.words & ~((self.words >> U64(1)) | (following << U64(63)))
        self.opens = self._before(self.words)
        self.leaves = self._before(self.leaf_words)
        steps = np.where(padded == 1, 1, -1).astype(np.int64).reshape(-1, 64)
        self.start = 2 * self.opens[:-1] - 64 * np.arange(len(self.words))  # excess in front of a block
        least = self.start + np.cumsum(steps, axis=1).min(axis=1, initial=64)
        self.levels = [least]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            if len(below) % 2:
                below = np.r_[below, np.iinfo(np.int64).max]
            self.levels.append(below.reshape(-1, 2).min(axis=1))

    @staticmethod
    def _before(words: np.ndarray) -> np.ndarray:
        """Set bits before each word, and in all."""
        return np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _rank(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(U64)
        inside = words[np.minimum(word, len(words) - 1)] & ((U64(1) << bit) - U64(1))
        return before[word] + np.bitwise_count(inside).astype(np.int64)

    def rank_open(self, at: np.ndarray) -> np.ndarray:
        """Opening bits before each place: the preorder number of the node that opens there."""
        return self._rank(self.words, self.opens, at)

    def rank_leaf(self, at: np.ndarray) -> np.ndarray:
        """Leaves that open before each place."""
        return self._rank(self.leaf_words, self.leaves, at)

    def excess(self, at: np.ndarray) -> np.ndarray:
        """Nodes open behind each place."""
        return 2 * self.rank_open(at + 1) - (at + 1)

    def _scan(self, at: np.ndarray, excess: np.ndarray, target: np.ndarray) -> np.ndarray:
        """From each place to the end of its block, the first at which the excess is ``target``; else -1."""
        found = np.full(len(at), -1, np.int64)
        left, at, excess = np.arange(len(at)), at.copy(), excess.copy()
        for _ in range(64):
            if not len(left):
                break
            bit = (self.words[at >> 6] >> (at & 63).astype(U64)) & U64(1)
            excess += 2 * bit.astype(np.int64) - 1
            hit = excess == target[left]
            found[left[hit]] = at[hit]
            go = ~hit & ((at & 63) < 63)
            left, at, excess = left[go], at[go] + 1, excess[go]
        return found

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Where each opening bit is closed: the next place with one node less open."""
        if not len(at):
            return np.empty(0, np.int64)
        before = self.excess(at)
        target = before - 1
        close = np.full(len(at), -1, np.int64)
        inside = np.flatnonzero((at & 63) < 63)
        close[inside] = self._scan(at[inside] + 1, before[inside], target[inside])
        left = np.flatnonzero(close < 0)
        # Up, to the first range to the right that goes low enough.
        block, level = at[left] >> 6, np.full(len(left), -1)
        for k, least in enumerate(self.levels):
            climbing = np.flatnonzero(level < 0)
            if not len(climbing):
                break
            right = block[climbing] + 1
            there = (block[climbing] % 2 == 0) & (right < len(least))
            there[there] = least[right[there]] <= target[left][climbing[there]]
            level[climbing[there]] = k
            block[climbing] = np.where(there, right, block[climbing] >> 1)
        # Down again, to the first block in that range.
        for k in range(len(self.levels) - 1, 0, -1):
            sinking = np.flatnonzero(level >= k)
            child = 2 * block[sinking]
            low = self.levels[k - 1][child] <= target[left][sinking]
            block[sinking] = np.where(low, child, child + 1)
        close[left] = self._scan(block * 64, self.start[block], target[left])
        return close
