"""Hashes of many byte spans at once: polynomial prefix sums modulo 2**64, then a mixing step.

A span's hash depends on its bytes and length alone, so equal spans of different documents and tasks agree.
"""

from __future__ import annotations

import numpy as np

#: Odd numbers picked freely; the second one makes an independent hash.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers_of(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n of each."""
    have = _powers.get(multiplier)
    if have is None or len(have[0]) < n:
        size = -(-n // (1 << 18)) << 18
        made = []
        for base in (multiplier, _inverse(multiplier)):
            line = np.full(size, base, np.uint64)
            line[0] = 1
            made.append(np.cumprod(line))
        have = (made[0], made[1])
        if size <= 1 << 21:  # a single huge text must not hold memory for good
            _powers[multiplier] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


class SpanHasher:
    """Hashes of spans of one byte array."""

    def __init__(self, data: np.ndarray, which: int = 0):
        powers, self.back = _powers_of(MULTIPLIERS[which], len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def fixed(self, length: int) -> np.ndarray:
        """Hashes of every span of one length, by start."""
        return mix((self.sums[length:] - self.sums[: len(self.sums) - length]) * self.back[: len(self.sums) - length])


class IntTable:
    """Open addressing from 64-bit keys to 64-bit values, for whole arrays at a time."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(MULTIPLIERS[0])) >> self.shift).astype(np.int64)

    def add(self, keys, values) -> None:
        """New keys, one by one; the table doubles when half full."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            held = self.keys >= 0
            keys, values = [*self.keys[held].tolist(), *keys], [*self.values[held].tolist(), *values]
            self.__init__((2 * len(keys)).bit_length() + 1)
        self.used += len(keys)
        for slot, key, value in zip(self._slot(np.array(keys, np.int64)).tolist(), keys, values):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.values[slot] = key, value

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    @classmethod
    def of(cls, keys: np.ndarray) -> IntTable:
        """A table from distinct keys to their places in the array, filled for all keys at once."""
        made = cls((2 * max(1, len(keys))).bit_length() + 1)
        slot, rest = made._slot(keys), np.arange(len(keys))
        while len(rest):
            free = np.flatnonzero(made.keys[slot[rest]] < 0)
            slots, first = np.unique(slot[rest[free]], return_index=True)
            placed = rest[free[first]]
            made.keys[slots], made.values[slots] = keys[placed], placed
            rest = np.setdiff1d(rest, placed, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & (len(made.keys) - 1)
        made.used = len(keys)
        return made
