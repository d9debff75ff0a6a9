"""A byte-level BPE vocabulary: token bytes, merge ranks, pair compatibility and word splitting.

The file is the JSON of a public tokenizer and its path is always a parameter. Each Python worker loads it once.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.path = path
        self.ids = {bytes(byte_of[c] for c in word): i for word, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.rank = dict.fromkeys(self.ids.values(), -1)
        for rank, merge in enumerate(model["merges"]):
            left, right = (bytes(byte_of[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, whole = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.rank_of_pair.setdefault(pair, rank)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = pair, rank
        self._kept: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}

    def stays_apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge of rank under `before` joins the end of `a` to the start of `b`.

        The merges that formed the two tokens are undone from the last on. While a pair of edge tokens
        existed, it must not have had a merge that goes before the one that used up either of them.
        Among equal ranks the left pair goes first.
        """
        rank, parts, merges = self.rank, self.parts, self.rank_of_pair
        while True:
            if merges.get((a, b), NEVER) < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes followed by b's bytes is a, b."""
        known = self._kept.get(a << 32 | b)
        if known is None:
            if len(self._kept) > 300_000:
                self._kept.clear()
            known = self._kept[a << 32 | b] = self.stays_apart(a, b)
        return known

    def stands_alone(self, token: int) -> bool:
        """Whether the encoding of the token's bytes is the token itself."""
        known = self._alone.get(token)
        if known is None:
            known = True
            if token in self.parts:
                left, right = self.parts[token]
                known = self.stands_alone(left) and self.stands_alone(right) and self.stays_apart(left, right, self.rank[token])
            self._alone[token] = known
        return known


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


LETTER, NUMBER, SPACE = 1, 2, 3
#: Unicode has no letters, numbers or spaces from here on: unassigned planes, tags and private use.
ASSIGNED = 0x34000


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE or 0 for every code point, as the tokenizers library's own regex engine sees it."""
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(ASSIGNED) if not 0xD800 <= c < 0xE000]
    every, where = "".join(map(chr, points)), np.array(points)
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            kinds[where[start:end]] = kind
    return kinds


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """Code points that this process's regex module classes otherwise, with one of the right class instead."""
    kinds = character_kinds()
    here = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        here[[ord(c) for c in regex.findall(pattern, every)]] = kind
    replace = {LETTER: "x", NUMBER: "0", SPACE: "\t", 0: "!"}
    return {int(c): replace[int(kinds[c])] for c in np.flatnonzero(here != kinds) if not 0xD800 <= c < 0xE000}


class Splitter:
    """The pieces that a pattern finds in a text, by the character classes of the tokenizers library."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.odd = stand_ins()
        self.odd_letters = frozenset(map(chr, self.odd))

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.odd_letters.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.odd))]


def special_splitter(special: dict[str, int]):
    """A function from a text to its parts; parts at odd places are special strings."""
    found = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    return lambda text: found.split(text) if found and "<" in text else [text]
