"""Token counts from two composed finite-state transducers, without writing tokens.

The outer one (segmenter) finds the words by chunk maps and a prefix scan. The inner one reads a word's bytes. Its state is
all that BPE still needs of the past: for each place where a token that is not over yet may have begun, the node in the
vocabulary's trie, the last token before that place, and how many tokens fewer had been counted there. Each transition is annotated with the
change of the count, so a word's count is the sum along its path. States are few and are compiled when first reached.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_slices, texts
from tidegauge.llm.hashing import IntTable, SpanHasher
from tidegauge.llm.segmenter import words
from tidegauge.llm.vocabulary import special_splitter, vocabulary

#: Compiled transitions that a worker keeps; beyond them it starts afresh, with the same counts.
KEPT_TRANSITIONS = 1 << 21
START, NARROW = 0, 24


class CountTransducer:
    def __init__(self, path: str):
        self.vocab = vocab = vocabulary(path)
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        nodes = 1
        inner = set()
        for text, token in vocab.ids.items():
            if not vocab.stands_alone(token):
                continue
            node = 0
            for byte in text:
                inner.add(node)
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            self.token[node] = token
        self.inner = inner
        self.reset()

    def reset(self) -> None:
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: START}
        self.edges: dict[int, int] = {}
        self.table = IntTable(16)

    def compile(self, key: int) -> int:
        """The transition of a state on a byte, as next state << 8 | change + 128."""
        state, byte = key >> 8, key & 255
        live, last, change = [], -1, 0
        for node, before, count in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token.get(node)
            if last < 0 and token is not None and (before < 0 or self.vocab.compatible(before, token)):
                last, change = token, count + 1
            if node in self.inner:
                live.append((node, before, count))
        signature = (*((n, b, c - change) for n, b, c in live), (0, last, 0))
        after = self.number.setdefault(signature, len(self.states))
        if after == len(self.states):
            self.states.append(signature)
        value = self.edges[key] = after << 8 | (change + 128)
        return value

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word; all words advance by one byte at a time, side by side."""
        if len(self.edges) > KEPT_TRANSITIONS:
            self.reset()
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        length, at = length[order], starts[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        step, active = 0, len(order)
        while active > NARROW:
            keys = state[:active] << 8 | data[at[:active] + step]
            found = self.table.find(keys)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                new, which = np.unique(keys[missing], return_inverse=True)
                compiled = [self.edges.get(key) or self.compile(key) for key in new.tolist()]
                self.table.add(new.tolist(), compiled)
                found[missing] = np.array(compiled)[which]
            state[:active] = found >> 8
            total[:active] += (found & 255) - 128
            step += 1
            active = int(np.searchsorted(-length, -step, "left"))
        for i in range(active):
            s, n = int(state[i]), 0
            for byte in data[at[i] + step : at[i] + int(length[i])].tolist():
                key = s << 8 | byte
                value = self.edges.get(key) or self.compile(key)
                s, n = value >> 8, n + (value & 255) - 128
            total[i] += n
        out = np.empty_like(total)
        out[order] = total
        return out


class TextCounter:
    def __init__(self, path: str):
        self.transducer, self.parts = CountTransducer(path), special_splitter(vocabulary(path).special)

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [self.parts(t) for t in texts]
        found = words([p for parts in split for p in parts[::2]])
        data = np.frombuffer(found.data, np.uint8)
        first, second = (SpanHasher(data, i)(found.starts, found.ends) for i in (0, 1))
        _, sample, which = np.unique(first, return_index=True, return_inverse=True)
        if (second != second[sample][which]).any():
            _, sample, which = np.unique(np.stack([first, second]), axis=1, return_index=True, return_inverse=True)
        each = self.transducer.counts(data, found.starts[sample], found.ends[sample])[which]
        of_text = np.repeat(np.arange(len(texts)), [len(p[::2]) for p in split])
        total = np.array([len(p) // 2 for p in split], np.int64)
        np.add.at(total, of_text[found.part], each)
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TextCounter:
    return TextCounter(path)


def count_tokens(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each on its own; other columns are left out.
    """

    def step(batch: pa.RecordBatch) -> dict:
        counts = counter(path)(batch.column("text").to_pylist())
        size = pc.binary_length(batch.column("text")).cast(pa.int64())
        return {"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": pa.array(counts, pa.int64())}

    kind = df.schema[id_col].dataType.simpleString()
    counted = map_slices(texts(df, id_col, text_col), step, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
