"""Token ids of many words at once, with the ids of words seen before kept in sorted arrays.

Only new words go through Python. Words are told apart by two independent 64-bit hashes. What is held is a number of words, about 40 bytes
each; when a generation is full it becomes the old one, and words found there move on into the next, so that frequent words are never lost.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from tidegauge.llm.hashing import SpanHasher
from tidegauge.llm.segmenter import Words

#: Words that two generations hold, words that wait to be sorted in, and bytes of words that hardly recur.
HELD, WAITING, LONG = 1_000_000, 32_768, 64


class Generation(NamedTuple):
    keys: np.ndarray
    checks: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    pool: np.ndarray

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Places, -1 where a word is missing."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def join(self, keys: np.ndarray, checks: np.ndarray, sizes: np.ndarray, pool: np.ndarray, starts: np.ndarray) -> Generation:
        """With more words, given by rising keys; of words with one key the first stays."""
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        inside = at < len(self.keys)
        new[inside] &= self.keys[at[inside]] != keys[inside]
        at, values = at[new], (keys[new], checks[new], starts[new] + len(self.pool), sizes[new])
        return Generation(*(np.insert(have, at, more) for have, more in zip(self[:4], values)), np.concatenate([self.pool, pool]))


EMPTY = Generation(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32))


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of a pool, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class WordIds:
    """`encode` gives the ids of a list of words, all in one array, and each word's number of ids."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], held: int = HELD):
        self.encode, self.most = encode, held // 2
        self.levels = [EMPTY, EMPTY, EMPTY]  # waiting, this and the last generation

    def __call__(self, found: Words, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each part has."""
        data = np.frombuffer(found.data, np.uint8)
        first, second = (SpanHasher(data, i)(found.starts, found.ends) for i in (0, 1))
        _, sample, which = np.unique(first, return_index=True, return_inverse=True)
        if (second != second[sample][which]).any():
            _, sample, which = np.unique(np.stack([first, second]), axis=1, return_index=True, return_inverse=True)
        starts, sizes, pool = self.ids_of(first[sample], second[sample], found.data, found.starts[sample], found.ends[sample])
        counts = np.bincount(found.part, sizes[which], parts).astype(np.int64)
        return gathered(pool, starts[which], sizes[which]), counts

    def ids_of(self, keys: np.ndarray, checks: np.ndarray, data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For different words by rising key: where the ids of each start in a pool, how many they are, and the pool."""
        starts, sizes, base = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), 0
        open_, moved = np.arange(len(keys)), np.zeros(len(keys), bool)
        for n, level in enumerate(self.levels):
            at = level.find(keys[open_], checks[open_])
            known, at = open_[at >= 0], at[at >= 0]
            starts[known], sizes[known] = level.starts[at] + base, level.sizes[at]
            moved[known] = n == 2
            open_, base = np.setdiff1d(open_, known, assume_unique=True), base + len(level.pool)
        new, made = self.encode([data[a:b] for a, b in zip(begin[open_].tolist(), end[open_].tolist())]) if len(open_) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        starts[open_], sizes[open_] = np.cumsum(made) - made + base, made
        pool = np.concatenate([*(level.pool for level in self.levels), new])
        keep = moved
        keep[open_] = end[open_] - begin[open_] <= LONG
        self.hold(keys[keep], checks[keep], sizes[keep], gathered(pool, starts[keep], sizes[keep]))
        return starts, sizes, pool

    def hold(self, keys: np.ndarray, checks: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> None:
        waiting, now, last = self.levels
        waiting = waiting.join(keys, checks, sizes, pool, np.cumsum(sizes) - sizes)
        if len(waiting.keys) > WAITING:
            now, waiting = now.join(waiting.keys, waiting.checks, waiting.sizes, waiting.pool, waiting.starts), EMPTY
        if len(now.keys) > self.most:
            now, last = EMPTY, now
        self.levels = [waiting, now, last]


def with_specials(ids: np.ndarray, counts: np.ndarray, split: list[list[str]], special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts by text, from those by part: parts at odd places of a text are special strings with an id of their own."""
    odd = [len(parts) // 2 for parts in split]
    if not any(odd):
        return ids, counts
    of_part = np.repeat(np.arange(len(split)), [n + 1 for n in odd])
    by_text = np.bincount(of_part, counts, len(split)).astype(np.int64) + np.array(odd)
    last = np.append(np.diff(of_part) > 0, True)
    return np.insert(ids, np.cumsum(counts)[~last], [special[s] for parts in split for s in parts[1::2]]), by_text
