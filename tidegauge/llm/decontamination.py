"""Benchmark decontamination by a distributed positional inverted index.

The index holds the postings of every word of the training texts. It is cut into segments of whole documents: a
segment has its own terms, and for each term the sorted places where it stands. Places run through all documents of a segment with one
place left free between two documents, so that no phrase crosses them. The segments are a written table.
Items are looked up segment by segment: the places of a window's rarest term, less its offset in the window, are the
possible starts; they are intersected with the offset-adjusted places of the other terms, from rare to frequent. What is left are
exact phrases, or with a `slop` all starts around which every term stands at most that far from its own offset.
Terms are compared as bytes, never as hashes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ascii_lower, col, release, rows_per_batch, slices, texts
from tidegauge.session import cut_lineage

#: Bytes of text in a segment, unless one text alone has more.
SEGMENT_BYTES = 1 << 22
#: Bytes of item text that are sent to the segments together, unless one item alone has more.
BLOCK_BYTES = 1 << 21
#: Possible starts that are looked at together.
STARTS = 1 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX = "segment bigint, doc_ids array<{kind}>, n_words array<int>, terms array<binary>, counts array<int>, places binary"
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
_in_word = np.ones(256, bool)
_in_word[:0x80] = False
_in_word[0x30:0x3A] = _in_word[0x61:0x7B] = True


def words_of(raw: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words of the texts in one array, and the number of words of each text."""
    data = _lower[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    inside = _in_word[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    last = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    n_words = np.diff(np.searchsorted(starts, last), prepend=0)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]), n_words


def first_places(n_words: np.ndarray) -> np.ndarray:
    """The place of each document's first word."""
    return np.cumsum(n_words) - n_words + np.arange(len(n_words))


def segment_of(batch: pa.RecordBatch, number: int) -> dict:
    words, n_words = words_of(batch.column("text").cast(pa.binary()).to_pylist())
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    places = order + np.repeat(np.arange(len(n_words)), n_words)[order]
    counts = np.bincount(codes, minlength=len(coded.dictionary))

    def cell(values) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return {"segment": pa.array([number], pa.int64()), "doc_ids": cell(batch.column("doc_id")), "n_words": cell(pa.array(n_words, pa.int32())),
            "terms": cell(coded.dictionary), "counts": cell(pa.array(counts, pa.int32())), "places": [places.astype("<i4").tobytes()]}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The positional index of all texts, one row per segment, as a table in the shared folder. Every row of `docs` is a document of its own."""

    def run(batches):
        partition, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, limit=segment_bytes):
                yield pa.RecordBatch.from_pydict(segment_of(piece, partition << 32 | n))
                n += 1
            release()

    return cut_lineage(texts(docs, id_col, text_col).mapInArrow(run, INDEX.format(kind=docs.schema[id_col].dataType.simpleString())))


class Segment(NamedTuple):
    terms: pa.Array
    counts: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    keys: np.ndarray
    span: int
    first: np.ndarray
    end: np.ndarray


def opened(terms: pa.Array, counts: np.ndarray, places: bytes, n_words: np.ndarray) -> Segment:
    counts, places = counts.astype(np.int64), np.frombuffer(places, "<i4").astype(np.int64)
    first = first_places(n_words.astype(np.int64))
    span = int(n_words.sum()) + len(n_words) + 1
    return Segment(terms, counts, np.cumsum(counts) - counts, places, np.repeat(np.arange(len(counts)), counts) * span + places, span, first, first + n_words)


def phrase_starts(window: np.ndarray, seg: Segment, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows (a row of term numbers each): window number, document row and start place of every match."""
    counts = seg.counts[window]
    order = np.argsort(counts, axis=1, kind="stable")
    every = np.arange(len(window))
    rare = order[:, 0]
    many = counts[every, rare]
    shifts = np.arange(-slop, slop + 1)
    out, begin = [], 0
    reach = np.cumsum(many) * len(shifts)
    while begin < len(window):
        stop = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + STARTS, "right")))
        own = every[begin:stop]
        w = np.repeat(own, many[own])
        within = np.arange(len(w)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
        anchor = seg.places[seg.starts[window[w, rare[w]]] + within]
        row = np.searchsorted(seg.first, anchor, "right") - 1
        start = ((anchor - rare[w])[:, None] + shifts).ravel()
        w, row = np.repeat(w, len(shifts)), np.repeat(row, len(shifts))
        for j in range(1, window.shape[1]):
            offset = order[w, j]
            low = np.maximum(start + offset - slop, seg.first[row])
            high = np.minimum(start + offset + slop, seg.end[row] - 1)
            term = window[w, offset] * seg.span
            at = np.searchsorted(seg.keys, term + low)
            here = at < len(seg.keys)
            here[here] = seg.keys[at[here]] <= (term + high)[here]
            w, row, start = w[here], row[here], start[here]
        out.append((w, row, start))
        begin = stop
    found = np.unique(np.stack([np.concatenate(x) for x in zip(*out)]), axis=1) if out else np.zeros((3, 0), np.int64)
    return found[0], found[1], found[2]


def lookup(items: pa.StructArray, seg: Segment, width: int, slop: int) -> tuple[np.ndarray, ...]:
    """item number, window offset, window length, document row and start (a word of that document, below 0 or past it only with a slop) of all matches."""
    lists = items.field("words")
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.cumsum(sizes) - sizes
    number = pc.index_in(flat.cast(pa.binary()), value_set=seg.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = []
    for length in np.unique(np.minimum(sizes, width)).tolist():
        if not length:
            continue
        own = np.flatnonzero(np.minimum(sizes, width) == length)
        many = sizes[own] - length + 1
        item = np.repeat(own, many)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        at = place[item] + offset
        missing = np.append(0, np.cumsum(number < 0))
        whole = missing[at + length] == missing[at]
        item, offset, at = item[whole], offset[whole], at[whole]
        w, row, start = phrase_starts(number[at[:, None] + np.arange(length)], seg, slop)
        out.append((item[w], offset[w], np.full(len(w), length), row, start - seg.first[row]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """Frames of one row with a bounded list of items each. Items without an id or a word take no part; repeated rows count once."""
    words = F.regexp_extract_all(ascii_lower(col(text_col)), F.lit(WORD), F.lit(0))
    given = items.select(col(id_col).cast("string").alias("item_id"), words.alias("words")).filter("item_id IS NOT NULL AND size(words) > 0").distinct()
    given = cut_lineage(given)
    size = F.sum(F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.octet_length(w) + 1))
    count = -(-(given.agg(size).first()[0] or 0) // block_bytes)
    dealt = given.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(count or 1)))
    return [dealt.filter(F.col("block") == i).agg(F.collect_list(F.struct("item_id", "words")).alias("items")) for i in range(count)]


def over_segments(index: DataFrame, block: DataFrame, step, schema: str) -> DataFrame:
    """`step(segment number, document ids, word counts, items, opened segment)` for each segment; the block's size is bounded, so it is broadcast.

    A written table: the segments went to Python one by one, as those of a whole task at once take hundreds of MB outside of the heap.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {k: batch.column(k)[i] for k in ("doc_ids", "n_words", "terms", "counts", "items")}
                n_words, counts = (cell[k].values.to_numpy(zero_copy_only=False) for k in ("n_words", "counts"))
                seg = opened(cell["terms"].values, counts, batch.column("places")[i].as_py(), n_words)
                yield pa.RecordBatch.from_pydict(step(batch.column("segment")[i].as_py(), cell["doc_ids"].values, n_words, cell["items"].values, seg))
            release()

    with rows_per_batch(index.sparkSession, 1):
        return cut_lineage(index.join(F.broadcast(block)).mapInArrow(run, schema))


def find_matches(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 0, item_id_col: str = "item_id", item_text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_word, start, length of every place where a window of an item occurs in an indexed text.

    A window is `width` consecutive words of an item, or all of a shorter one; `item_word` and `start` count words from 0. With a `slop`
    a match is a start where each word of the window stands within `slop` words of its own place, in the same document.
    Null and empty texts hold nothing; documents without an id are reported with a null id; an empty side gives no rows.
    """
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def step(number, doc_ids, n_words, given, seg):
        item, offset, length, row, start = lookup(given, seg, width, slop)
        return {"doc_id": doc_ids.take(pa.array(row)), "item_id": given.field("item_id").take(pa.array(item)), "item_word": offset, "start": start, "length": length}

    schema = f"doc_id {kind}, item_id string, item_word bigint, start bigint, length bigint"
    found = [over_segments(index, block, step, schema) for block in item_blocks(items, item_id_col, item_text_col, block_bytes)]
    if not found:
        return index.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the runs that overlapping or touching spans of a row make together."""
    order = np.lexsort((end, start, row))
    row, start, end = row[order], start[order], end[order]
    far = row * (int(end.max(initial=0)) + 2)  # rows lie apart, so one running maximum serves all
    reach = np.maximum.accumulate(end + far)
    new = np.ones(len(row), bool)
    new[1:] = (start + far)[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(row)) - 1
    return row[new], start[new], (reach - far)[last] if len(row) else end


def contamination(index: DataFrame, items: DataFrame, width: int = 10, item_id_col: str = "item_id", item_text_col: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per indexed document: doc_id, n_words, spans (start and end words of hit runs), items (ids found, as sorted strings).

    Documents with null or empty text have no words; rows with one id are documents of their own; items with one id count once; without
    items no word is hit.
    """
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    blocks = item_blocks(items, item_id_col, item_text_col, block_bytes)

    def step(number, doc_ids, n_words, given, seg):
        item, _, length, row, start = lookup(given, seg, width, 0)
        run_row, run_start, run_end = joined(row, start, start + length)
        has, which = np.unique(np.stack([row, item]), axis=1)
        rows = np.arange(len(n_words))

        def cells(of: np.ndarray, values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(of, rows), len(of)), pa.int32()), values)

        spans = pa.StructArray.from_arrays([pa.array(run_start, pa.int64()), pa.array(run_end, pa.int64())], names=["start", "end"])
        return {"segment": pa.array(np.full(len(rows), number), pa.int64()), "row": pa.array(rows, pa.int64()), "doc_id": doc_ids, "n_words": pa.array(n_words, pa.int64()),
                "spans": cells(run_row, spans), "items": cells(has, given.field("item_id").take(pa.array(which, pa.int64())))}

    if not blocks:
        each = index.select(F.inline(F.arrays_zip("doc_ids", "n_words"))).select(F.col("doc_ids").alias("doc_id"), F.col("n_words").cast("bigint").alias("n_words"))
        return each.withColumn("spans", F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)")).withColumn("items", F.expr("CAST(array() AS array<string>)"))
    schema = f"segment bigint, row bigint, doc_id {kind}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
    found = over_segments(index, blocks[0], step, schema)
    for block in blocks[1:]:
        found = found.unionAll(over_segments(index, block, step, schema).filter("size(items) > 0"))
    whole = found.groupBy("segment", "row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                                F.flatten(F.collect_list("items")).alias("items"))
    return whole.select("doc_id", "n_words", F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def covered(spans: str) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(spans, start, step, lambda a: a["n"])
