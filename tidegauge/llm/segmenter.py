"""Word boundaries of the byte-level tokenizer as a finite-state transducer over whole batches of text.

The pattern's look-ahead and contractions need only twelve states. A transition tells whether a word starts at this
character and, once it is known, whether one started at the character before. Each chunk of characters is a map from the
state before it to the state after it; the maps are composed by a parallel prefix scan, which gives every chunk its
real entry state, and a second pass over all chunks side by side writes the boundaries.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

from tidegauge.llm.vocabulary import LETTER, NUMBER, SPACE, character_kinds

CHUNK, PROBE = 256, 6
#: A lone surrogate cannot be in a text, so it marks where a part ends.
END = "\ud800"
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, BLANK, WHITE, BLANK_AFTER, WHITE_AFTER, APOSTROPHE, AFTER_R, AFTER_V, AFTER_L) = range(12)
(END_OF_PART, A_LETTER, ENDS_ONE, AN_R, A_V, AN_L, AN_E, A_NUMBER, A_BLANK, A_WHITE, AN_APOSTROPHE, AN_OTHER) = range(12)
HERE, BEFORE = 1, 2


def _move(state: int, symbol: int, plain: bool) -> tuple[int, int]:
    """Next state, and which starts are now known.

    A plain pattern keeps white space apart from words and takes numbers one by one.
    """
    letters = symbol in (A_LETTER, ENDS_ONE, AN_R, A_V, AN_L, AN_E)
    waiting = {AFTER_R: AN_E, AFTER_V: AN_E, AFTER_L: AN_L}
    if state in waiting:
        if symbol == waiting[state]:
            return FRESH, 0
        after, known = _move(IN_LETTERS, symbol, plain)
        return after, known | BEFORE
    if state == APOSTROPHE:
        if symbol == ENDS_ONE:
            return FRESH, 0
        if symbol in (AN_R, A_V, AN_L):
            return {AN_R: AFTER_R, A_V: AFTER_V, AN_L: AFTER_L}[symbol], 0
        return _move(IN_OTHERS, symbol, plain)
    if symbol == END_OF_PART:
        return FRESH, HERE
    spaces = state in (BLANK, WHITE, BLANK_AFTER, WHITE_AFTER)
    if plain and symbol in (A_BLANK, A_WHITE):
        return WHITE, 0 if spaces else HERE
    if plain and symbol == A_NUMBER:
        return IN_NUMBERS, HERE
    if symbol in (A_BLANK, A_WHITE):
        if spaces:
            return (BLANK_AFTER if symbol == A_BLANK else WHITE_AFTER), 0
        return (BLANK if symbol == A_BLANK else WHITE), HERE
    # The last blank of a run of white space belongs to the word after it; other white space stands alone.
    known = {BLANK: 0, WHITE: HERE, BLANK_AFTER: BEFORE, WHITE_AFTER: BEFORE | HERE}.get(state, HERE)
    joined = state in (BLANK, BLANK_AFTER)
    if letters:
        return IN_LETTERS, 0 if state == IN_LETTERS else known
    if symbol == A_NUMBER:
        return IN_NUMBERS, 0 if state == IN_NUMBERS else known
    if state == IN_OTHERS:
        return IN_OTHERS, 0
    return (APOSTROPHE if symbol == AN_APOSTROPHE and not joined else IN_OTHERS), known


STATES = 12
NEXT, STARTS = (np.array([[[_move(s, c, plain)[i] for c in range(12)] for s in range(STATES)] for plain in (False, True)], np.uint8) for i in (0, 1))


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The transducer's input symbol of every code point."""
    kinds = character_kinds()
    out = np.full(0x110000, AN_OTHER, np.uint8)
    out[kinds == LETTER], out[kinds == NUMBER], out[kinds == SPACE] = A_LETTER, A_NUMBER, A_WHITE
    for text, symbol in (("stmd", ENDS_ONE), ("r", AN_R), ("v", A_V), ("l", AN_L), ("e", AN_E), (" ", A_BLANK), ("'", AN_APOSTROPHE), (END, END_OF_PART)):
        out[[ord(c) for c in text]] = symbol
    return out


def chunk_maps(columns: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each chunk (a column) the state after it for every state before it.

    After a few characters nearly every chunk has forgotten its entry state; from there one state is carried for all.
    """
    flat = table.reshape(-1)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], columns.shape[1], 1)
    for row in columns[:PROBE]:
        maps = flat[maps * 12 + row]
    same = (maps == maps[0]).all(0)
    one, several = maps[0], np.flatnonzero(~same)
    rest = maps[:, several]
    for row in columns[PROBE:]:
        one = flat[one * 12 + row]
        if len(several):
            rest = flat[rest * 12 + row[several]]
    out = np.repeat(one[None], STATES, 0)
    out[:, several] = rest
    return out


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Composition of each chunk's map with all maps before it, in a logarithmic number of steps."""
    done, step = maps.copy(), 1
    while step < done.shape[1]:
        done[:, step:] = np.take_along_axis(done[:, step:], done[:, :-step], 0)
        step *= 2
    return done


class Words(NamedTuple):
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    part: np.ndarray


def words(parts: list[str], plain: bool = False) -> Words:
    """UTF-8 bytes of the joined parts, and the byte offsets and part number of each word."""
    following, starting = NEXT[int(plain)], STARTS[int(plain)]
    joined = END.join(parts) + END
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    chunks = -(-n // CHUNK)
    line = np.full(chunks * CHUNK, END_OF_PART, np.uint8)
    line[:n] = symbols()[points]
    columns = np.ascontiguousarray(line.reshape(chunks, CHUNK).T)
    after = prefix_scan(chunk_maps(columns, following))
    state = np.concatenate([[FRESH], after[FRESH, :-1]]).astype(np.uint8)
    known = np.empty_like(columns)
    flat_next, flat_starts = following.reshape(-1), starting.reshape(-1)
    for j, row in enumerate(columns):
        at = state * 12 + row
        known[j] = flat_starts[at]
        state = flat_next[at]
    known = known.T.reshape(-1)[:n]
    start = (known & HERE).astype(bool)
    start[:-1] |= (known[1:] & BEFORE).astype(bool)
    ends_part = line[:n] == END_OF_PART
    start |= ends_part
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.cumsum(size) - size
    first = np.flatnonzero(start)
    last = np.append(first[1:], n)
    of_word = ~ends_part[first]
    if plain:
        of_word &= (line[first] != A_BLANK) & (line[first] != A_WHITE)
    part = (np.cumsum(ends_part) - ends_part)[first]
    ends = np.append(offset, offset[-1] + size[-1])[last]
    return Words(joined.encode("utf-8", "surrogatepass"), offset[first][of_word], ends[of_word], part[of_word])
