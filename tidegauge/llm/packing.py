"""Packing by power-of-two decomposition.

A document's n ids are cut into as many full sequences as fit and then into the binary digits of the rest, largest first.
Every piece is a sequence of its own, so no sequence crosses documents and none needs padding. Sequences of
equal length form a bucket; a sequence's number names its bucket, the writing partition and its place there, so numbers
are unique without any exchange between tasks.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidegauge.llm.common import release, slices, texts
from tidegauge.llm.segmenter import words
from tidegauge.llm.vocabulary import byte_letters, special_splitter
from tidegauge.llm.word_ids import WordIds, with_specials

BUCKET_SHIFT, PARTITION_SHIFT = 56, 32
#: Below, lower case and normal forms are the same in all versions of Unicode.
SETTLED = "\u0250"


class WordEncoder:
    """Ids of whole texts by a tokenizer with word ends: each different word goes to the tokenizers library's model once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, dict(enumerate(byte_letters()))
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.parts, self.ids = special_splitter(self.special), WordIds(self.encode_words)

    def encode_words(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters, ids, sizes = self.model.tokenize, self.letters, [], []
        for word in new:
            text = word.decode()
            if max(text) < SETTLED:
                plain = text.isascii() and text.isprintable()
                own = [t.id for t in tokenize(text if plain else word.decode("latin-1").translate(letters))]
            else:
                own = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids += own
            sizes.append(len(own))
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and each text's number of ids."""
        split = [self.parts(t) for t in texts]
        # Lower case letter by letter, as the library has it: no final form of sigma.
        plain = [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for parts in split for p in parts[::2]]
        return with_specials(*self.ids(words(plain, plain=True), len(plain)), split, self.special)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        ids, counts = self.flat(texts)
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    return WordEncoder(path)


def pieces(counts: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and length of all pieces, in order: full sequences, then the binary digits of the rest."""
    bits = np.arange(largest.bit_length() - 1, -1, -1)
    document, digit = np.nonzero((counts % largest)[:, None] >> bits & 1)
    full = np.repeat(np.arange(len(counts)), counts // largest)
    document, length = np.append(full, document), np.append(np.full(len(full), largest), 1 << bits[digit])
    order = np.argsort(document, kind="stable")
    return document[order], length[order]


def binary_lengths(n: int, largest: int) -> list[int]:
    """Lengths of the pieces of a document with n ids."""
    return pieces(np.array([n]), largest)[1].tolist()


def pack(df: DataFrame, path: str, largest: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed little-endian 32-bit), doc_tokens, sequence_id, sequence_offset.

    `largest` is a power of two. A document is its ids followed by `end_id`, so null and empty texts give one piece with that id
    alone. Repeated rows are packed each on its own; other columns are left out. An empty table gives no pieces.
    """
    if largest < 1 or largest & (largest - 1):
        raise ValueError(f"sequences need a power of two as their length, not {largest}")

    def run(batches):
        partition, used = TaskContext.get().partitionId(), np.zeros(largest.bit_length(), np.int64)
        for batch in batches:
            for part in slices(batch):
                ids, counts = word_encoder(path).flat(part.column("text").to_pylist())
                ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), counts + 1
                row, length = pieces(counts, largest)
                # Pieces follow each other as the ids do, so the ids are cut where they stand.
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(counts) - counts)[row]
                bucket = np.log2(length).astype(np.int64)
                number = np.empty(len(row), np.int64)
                for b in np.unique(bucket).tolist():
                    own = np.flatnonzero(bucket == b)
                    number[own] = used[b] + np.arange(len(own))
                    used[b] += len(own)
                cut = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((4 * np.append(0, ends)).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(row)), "start": start, "length": length, "ids": cut, "doc_tokens": counts[row],
                                                  "sequence_id": bucket << BUCKET_SHIFT | partition << PARTITION_SHIFT | number, "sequence_offset": np.zeros(len(row), np.int64)})
            release()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, sequence_offset bigint"
    return texts(df, id_col, text_col).mapInArrow(run, schema)
