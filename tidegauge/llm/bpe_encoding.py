"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

A word's encoding is fixed by one fact for each of its prefixes: the last token of that prefix's encoding. It is the one
token that ends there, follows the last token of the shorter prefix compatibly, and stands alone. A suffix automaton over
the vocabulary finds the tokens that end at each place, and the ids come from following the last tokens back.
Time is linear in a word's length, however long it is.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidegauge.llm.common import col, map_slices, texts
from tidegauge.llm.segmenter import words
from tidegauge.llm.vocabulary import Vocabulary, special_splitter, vocabulary
from tidegauge.llm.word_ids import WordIds, with_specials


class SuffixAutomaton:
    """All substrings of the given strings. State 0 is the empty string."""

    def __init__(self, strings):
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in strings:
            last = 0
            for byte in s:
                last = self._extend(last, byte)

    def _split(self, p: int, byte: int, q: int) -> int:
        """The state of the longest string of p followed by byte, split off q where q holds longer ones."""
        edges, link, length = self.edges, self.link, self.length
        if length[p] + 1 == length[q]:
            return q
        clone = len(edges)
        edges.append(dict(edges[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and edges[p].get(byte) == q:
            edges[p][byte] = clone
            p = link[p]
        return clone

    def _extend(self, last: int, byte: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        if byte in edges[last]:
            return self._split(last, byte, edges[last][byte])
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and byte not in edges[p]:
            edges[p][byte] = new
            p = link[p]
        if p >= 0:
            link[new] = self._split(p, byte, edges[p][byte])
        return new


class PrefixEncoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        tokens = {b: i for b, i in vocab.ids.items() if vocab.stands_alone(i)}
        self.automaton = a = SuffixAutomaton(tokens)
        # Of each state, the tokens among its own string and the suffixes that its links lead to, longest first.
        own: dict[int, tuple[int, int]] = {}
        for b, i in tokens.items():
            state = 0
            for byte in b:
                state = a.edges[state][byte]
            own[state] = (len(b), i)
        self.own = own
        self.tokens: dict[int, tuple[tuple[int, int], ...]] = {0: ()}

    def ending(self, state: int) -> tuple[tuple[int, int], ...]:
        found, chain = self.tokens.get(state), [state]
        while found is None:
            chain.append(self.automaton.link[chain[-1]])
            found = self.tokens.get(chain[-1])
        for s in reversed(chain):
            if s not in self.tokens:
                self.tokens[s] = found = ((self.own[s],) if s in self.own else ()) + self.tokens[self.automaton.link[s]]
        return self.tokens[state]

    def sorted_words(self, words) -> list[bytes]:
        """Packed ids of each word. Sorted words share what is known of their common prefix with the word before."""
        edges, link, length = self.automaton.edges, self.automaton.link, self.automaton.length
        kept, compatible, ending = self.vocab._kept, self.vocab.compatible, self.ending
        tokens = self.tokens
        # By prefix length: the unique last token, its size, and the automaton's state and match.
        last, size, states, matches = [-1], [0], [0], [0]
        out, before = [], b""
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], states[shared + 1 :], matches[shared + 1 :]
            state, matched, before = states[shared], matches[shared], word
            for end in range(shared + 1, len(word) + 1):
                byte = word[end - 1]
                while byte not in edges[state]:
                    state = link[state]
                    matched = length[state]
                state = edges[state][byte]
                matched += 1
                # A state's own string may be longer than the match; its suffix states never are.
                at = state if length[state] == matched else link[state]
                for n, token in tokens.get(at) or ending(at):
                    if n == end:
                        break
                    fits = kept.get(last[end - n] << 32 | token)
                    if compatible(last[end - n], token) if fits is None else fits:
                        break
                last.append(token)
                size.append(n)
                states.append(state)
                matches.append(matched)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= size[end]
            out.append(array("I", ids[::-1]).tobytes())
        return out


class TextEncoder:
    """Packed little-endian 32-bit ids of whole texts; special strings in a text give their own ids."""

    def __init__(self, path: str):
        vocab = vocabulary(path)
        self.prefixes, self.parts = PrefixEncoder(vocab), special_splitter(vocab.special)
        self.special, self.ids = vocab.special, WordIds(self.encode_words)

    def encode_words(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(new)), key=new.__getitem__)
        packed = [b""] * len(new)
        for i, ids in zip(order, self.prefixes.sorted_words([new[i] for i in order])):
            packed[i] = ids
        return np.frombuffer(b"".join(packed), np.uint32), np.fromiter(map(len, packed), np.int64, len(packed)) // 4

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and each text's number of ids."""
        split = [self.parts(t) for t in texts]
        plain = [p for parts in split for p in parts[::2]]
        return with_specials(*self.ids(words(plain), len(plain)), split, self.special)

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.flat(texts)
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


@lru_cache(maxsize=2)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, and where each id's bytes start and how many there are."""
    of = vocabulary(path).bytes_of
    every = [of.get(i, b"") for i in range(max(of) + 1)]
    sizes = np.array([len(b) for b in every])
    return np.frombuffer(b"".join(every), np.uint8), np.cumsum(sizes) - sizes, sizes


def decoded_texts(path: str, flat: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts that consecutive runs of ids stand for; bytes that are no UTF-8 become U+FFFD, as the tokenizers library has it."""
    table, starts, sizes = token_table(path)
    length = sizes[flat]
    ends = np.cumsum(length)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[flat] - (ends - length), length)
    line = table[where].tobytes()
    edges = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
    return [line[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids array<int> of every whole text, and on request the text that the ids decode to.

    Null and empty texts give an empty array; repeated rows and ids are encoded each on its own; other columns are left out.
    """

    def step(batch: pa.RecordBatch) -> dict:
        flat, counts = encoder(path).flat(batch.column("text").to_pylist())
        flat = flat.astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat))
        more = {"decoded": pa.array(decoded_texts(path, flat, counts), pa.string())} if decoded else {}
        return {"doc_id": batch.column("doc_id"), "ids": ids, **more}

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(texts(df, id_col, text_col), step, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The frame without its ids, and the text that they stand for.

    Null ids give a null text; see decoded_texts().
    """
    kept = [f for f in df.schema.fields if f.name != ids_col]
    names = [f"_{i}" for i in range(len(kept))]
    narrow = df.select(*[col(f.name).alias(n) for f, n in zip(kept, names, strict=True)], col(ids_col).alias("_ids"))

    def step(batches):
        for batch in batches:
            lists = batch.column("_ids")
            counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            found = decoded_texts(path, lists.flatten().to_numpy(zero_copy_only=False), counts)
            found = [t if valid else None for t, valid in zip(found, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.string())], [*names, "_out"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for f, n in zip(kept, names, strict=True))
    done = narrow.mapInArrow(step, f"{schema}, _out string" if schema else "_out string")
    return done.select(*[col(n).alias(f.name) for f, n in zip(kept, names, strict=True)], col("_out").alias(out))
