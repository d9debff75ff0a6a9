"""Removal of repeated substrings by refining buckets of text positions.

Every 100-byte string (window) must be compared with all others, but positions are too many to move. So each window is
represented by its anchor, the place of its least GRAM-byte string by hash: equal windows have the same anchor, and about one
position in 35 is the anchor of anything. Buckets of positions are then refined step by step, and what one step has
settled is used by all later ones:
1. A bucket holds the anchors with the same GRAM-byte string.
2. It is sorted by the identifier of all bytes that the anchor's windows span. Of equal spans all but the earliest are settled at
   once: every window of theirs has an earlier equal. A bucket with a single kind of span is done.
3. The earliest ones of buckets with several kinds are refined by the identifiers of their windows at each later offset: small
   buckets side by side in one task, large ones dealt out by window, so no bucket is too large for a task.
Settled windows go back to their documents as intervals. Texts move compressed, once for step 3 and once for the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import col, release, slices
from tidegauge.llm.hashing import SpanHasher
from tidegauge.session import cut_lineage

GRAM = 32
#: Bytes of a text that are looked at together; longer texts go piece by piece, overlapping by a window.
PIECE = 1 << 19
#: Bits of a gram's hash that name a bucket. Buckets that share a name are only refined together.
BUCKET_BITS = 63
#: Kinds of spans up to which a bucket is refined in one task.
SMALL_BUCKET = 512
#: Anchors that a task sorts together before they leave it.
TOGETHER = 400_000
COVER, SPANS, WINDOWS = 2, 0, 1
NO_ID = (1 << 63) - 1


def anchors(pieces: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: piece number, first window, number of windows, bucket and span identifier."""
    gram = min(GRAM, width)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces], np.int64)
    if not (size >= width).any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = SpanHasher(data)
    grams = sums.fixed(gram)
    # High bits order the grams, low bits the places: among equal grams of a window the first one is the least.
    place_bits = np.uint64(int(len(grams)).bit_length())
    low = (np.uint64(1) << place_bits) - np.uint64(1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, wanted = 1, width - gram + 1
    while span < wanted:
        step = min(span, wanted - span)
        key = np.minimum(key[:-step], key[step:])
        span += step
    ends = np.cumsum(size)
    starts = ends - size
    count = np.maximum(size - width + 1, 0)
    window = np.arange(int(count.sum())) + np.repeat(starts - (np.cumsum(count) - count), count)
    piece = np.repeat(np.arange(len(pieces)), count)
    at = (key[window] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    p0, anchor, piece = window[first], at[first], piece[first]
    identifier = SpanHasher(data, 1)(p0, p0 + n + width - 1) ^ ((anchor - p0).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return piece, p0 - starts[piece], n, (grams[anchor] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), identifier.view(np.int64)


def text_pieces(raw: list[bytes], width: int):
    """Groups of (row, offset, bytes) with about PIECE bytes."""
    group, held = [], 0
    for row, text in enumerate(raw):
        for offset in range(0, max(1, len(text) - width + 1), PIECE):
            piece = text[offset : offset + PIECE + width - 1]
            group.append((row, offset, piece))
            held += len(piece)
            if held >= PIECE:
                yield group
                group, held = [], 0
    if group:
        yield group


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _pack(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run of windows as one number that sorts by its start."""
    return first << 21 | count


def _later(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted row equals the row before it in all keys."""
    same = np.ones(len(keys[0]), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[1:] == k[:-1]
    return same


def _after_first(same: np.ndarray, doc: np.ndarray, place: np.ndarray, first: tuple | None = None) -> tuple[np.ndarray, tuple | None]:
    """Where a row, sorted by place within its group, stands at a later place than the group's first, and the last group's first place.

    `same` tells whether a row is of the group of the row before it; `first` is that of the group that goes on at the beginning. Rows of one
    id at one place take nothing from each other, and all of them lose what stands earlier.
    """
    if not len(same):
        return same, first
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    first_doc, first_place = doc[head], place[head]
    if same[0]:
        goes_on = np.logical_and.accumulate(same)
        first_doc[goes_on], first_place[goes_on] = first
    return same & ((doc != first_doc) | (place != first_place)), (first_doc[-1], first_place[-1])


def _anchor_rows(width: int):
    """Step 1: the anchors. Of equal spans found together only the earliest goes on as a bucket entry."""

    def settled(found) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*found)]
        doc, p0, n, bucket, span, text_key = columns
        order = np.lexsort((text_key, p0, doc, span, bucket))
        columns = [x[order] for x in columns]
        doc, p0, n, bucket, span, text_key = columns
        later, _ = _after_first(_later(bucket, span), doc, p0)
        # Rows with equal id and text are told once.
        once = ~_later(bucket, span, doc, p0, text_key)
        doc, p0, n, bucket, span, text_key, later = (x[once] for x in (*columns, later))
        key = np.where(later, doc ^ text_key, bucket)  # covers are spread by row: ids and texts may both repeat
        return _batch(kind=pa.array(np.where(later, COVER, SPANS), pa.int8()), key=key, span=np.where(later, 0, span), doc_id=doc, run=_pack(p0, n), text_key=text_key)

    def run(batches):
        for batch in batches:
            found, held = [], 0
            for part in slices(batch):
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                text_key = part.column("text_key").to_numpy(zero_copy_only=False)
                for group in text_pieces([t.encode() for t in part.column("text").to_pylist()], width):
                    piece, p0, n, bucket, span = anchors([g[2] for g in group], width)
                    row, offset = (np.array([g[i] for g in group], np.int64)[piece] for i in (0, 1))
                    found.append((ids[row], p0 + offset, n, bucket, span, text_key[row]))
                    held += len(piece)
                if held >= TOGETHER:
                    yield settled(found)
                    found, held = [], 0
            if found:
                yield settled(found)
            release()

    return run


ANCHOR_ROWS = "kind tinyint, key bigint, span bigint, doc_id bigint, run bigint, text_key bigint"


def _settle_spans(batches):
    """Step 2, over rows sorted by (kind, key, span, doc_id, run, text_key): covers, and what is left to refine."""
    held = None  # earliest entries of the last bucket, which may go on in the next batch
    large = -1  # the last bucket, once it is known to be large
    last = first = None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "span", "doc_id", "run", "text_key")]
        kind, key, span, doc, run, text_key = columns
        if not len(key):
            continue
        entry = kind == SPANS
        same, repeats = _later(kind, key, span), _later(*columns)
        if last is not None:
            same[0] = (kind[0], key[0], span[0]) == last[:3]
            repeats[0] = tuple(x[0] for x in columns) == last
        last = tuple(x[-1] for x in columns)
        later, first = _after_first(same, doc, run, first)
        cover = ~entry | (later & ~repeats)
        yield _batch(kind=pa.array(np.full(int(cover.sum()), COVER), pa.int8()), key=key[cover], doc_id=doc[cover], run=run[cover], text_key=text_key[cover])
        rows = [x[entry & ~later & ~repeats] for x in (key, doc, run, text_key)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
            held = None
        if not len(rows[0]):
            continue
        edge = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
        size = np.diff(np.append(edge, len(rows[0])))
        of = np.repeat(np.arange(len(edge)), size)
        how = np.where((size > SMALL_BUCKET) | (rows[0][edge] == large), WINDOWS, SPANS)
        out = (size[of] > 1) | (how[of] == WINDOWS)
        if how[-1] == WINDOWS:
            large = int(rows[0][-1])
        else:
            held = [x[edge[-1] :] for x in rows]
            out[edge[-1] :] = False
        yield _batch(kind=pa.array(how[of][out], pa.int8()), key=rows[0][out], doc_id=rows[1][out], run=rows[2][out], text_key=rows[3][out])
    if held is not None and len(held[0]) > 1:
        yield _batch(kind=pa.array(np.full(len(held[0]), SPANS), pa.int8()), key=held[0], doc_id=held[1], run=held[2], text_key=held[3])


SETTLED_ROWS = "kind tinyint, key bigint, doc_id bigint, run bigint, text_key bigint"


def _refine_rows(width: int):
    """Step 3, from documents with their open runs: a small bucket's run with its bytes, a large one's windows one by one."""

    def run(batches):
        unpack, last = zstandard.ZstdDecompressor().decompress, None
        for batch in batches:
            small, windows = [], []
            for doc, text_key, packed, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("packed"), batch.column("runs")):
                if (doc, text_key) == last:  # equal id and text
                    continue
                last = (doc, text_key)
                text = unpack(packed.as_py())
                kinds, keys, places = (runs.values.field(f).to_numpy(zero_copy_only=False) for f in ("kind", "key", "run"))
                first, n = places >> 21, places & ((1 << 21) - 1)
                # Two texts of one id may share a hash; a place beyond this one's text belongs to another.
                fits = first + n + width - 1 <= len(text)
                for i in np.flatnonzero(fits & (kinds == SPANS)):
                    small.append((keys[i], doc, places[i], text_key, text[first[i] : first[i] + n[i] + width - 1]))
                open_ = np.flatnonzero(fits & (kinds == WINDOWS))
                if len(open_):
                    data = np.frombuffer(text, np.uint8)
                    p = np.unique(np.arange(int(n[open_].sum())) + np.repeat(first[open_] - (np.cumsum(n[open_]) - n[open_]), n[open_]))
                    windows.append((*(SpanHasher(data, w)(p, p + width).view(np.int64) for w in (0, 1)), np.full(len(p), doc), p, np.full(len(p), text_key)))
            if small:
                key, doc, place, text_key, data = zip(*small)
                yield _batch(kind=pa.array(np.full(len(key), SPANS), pa.int8()), key=pa.array(key, pa.int64()), check=pa.array(np.zeros(len(key), np.int64)),
                             doc_id=pa.array(doc, pa.int64()), run=pa.array(place, pa.int64()), text_key=pa.array(text_key, pa.int64()), data=pa.array(data, pa.binary()))
            if windows:
                key, check, doc, p, text_key = (np.concatenate(x) for x in zip(*windows))
                order = np.lexsort((text_key, p, doc, check, key))
                key, check, doc, p, text_key = (x[order] for x in (key, check, doc, p, text_key))
                settled, _ = _after_first(_later(key, check), doc, p)
                yield _batch(kind=pa.array(np.where(settled, COVER, WINDOWS), pa.int8()), key=np.where(settled, doc ^ text_key, key), check=np.where(settled, 0, check),
                             doc_id=doc, run=_pack(p, np.ones(len(p), np.int64)), text_key=text_key, data=pa.nulls(len(p), pa.binary()))
            release()

    return run


REFINE_ROWS = "kind tinyint, key bigint, check bigint, doc_id bigint, run bigint, text_key bigint, data binary"


def _settle_windows(width: int):
    """The last step, over rows sorted by (kind, key, check, doc_id, run, text_key): covers only."""

    def small_buckets(key, doc, run, text_key, data: pa.Array):
        """Windows of every run, compared within the bucket."""
        n = run & ((1 << 21) - 1)
        line = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        starts = np.cumsum(n + width - 1) - (n + width - 1)
        row = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = starts[row] + j
        one, two = (SpanHasher(line, w)(at, at + width) for w in (0, 1))
        p = (run >> 21)[row] + j
        order = np.lexsort((p, doc[row], two, one, key[row]))
        same, _ = _after_first(_later(one[order], two[order], key[row][order]), doc[row][order], p[order])
        hit = np.zeros(len(row), bool)
        hit[order] = same
        first = hit & np.append(True, ~hit[:-1] | (row[1:] != row[:-1]))
        length = np.diff(np.append(np.flatnonzero(first), len(row)))
        number = np.cumsum(first) - 1
        length = np.bincount(number[hit], minlength=len(length))
        return _batch(doc_id=doc[row][first], run=_pack(p[first], length), text_key=text_key[row][first])

    def run(batches):
        held, last, first = None, None, None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
            kind, key, check, doc, place, text_key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "check", "doc_id", "run", "text_key"))
            own = kind != SPANS
            same = _later(kind, key, check)
            if last is not None and len(key):
                same[0] = (kind[0], key[0], check[0]) == last
            if len(key):
                last = (kind[-1], key[-1], check[-1])
            later, first = _after_first(same, doc, place, first)
            cover = (kind == COVER) | ((kind == WINDOWS) & later)
            yield _batch(doc_id=doc[cover], run=place[cover], text_key=text_key[cover])
            spans = [key[~own], doc[~own], place[~own], text_key[~own], batch.column("data").filter(pa.array(~own))]
            if held is not None:
                spans = [*(np.concatenate(x) for x in zip(held[:4], spans[:4])), pa.concat_arrays([held[4], spans[4]])]
                held = None
            if len(spans[0]):
                # The last bucket may go on, and is bounded.
                edge = int(np.searchsorted(spans[0], spans[0][-1])) if not own.any() else len(spans[0])
                if edge < len(spans[0]):
                    held = [*(x[edge:] for x in spans[:4]), spans[4].slice(edge)]
                if edge:
                    yield small_buckets(*(x[:edge] for x in spans[:4]), spans[4].slice(0, edge))
            release()
        if held is not None:
            yield small_buckets(*held)

    return run


def _whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Only characters whose bytes are all gone."""
    lead = (text & 0xC0) != 0x80
    return np.logical_and.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead) - 1]


def _cut(width: int, kept_fields: list[str], whole_characters: bool):
    """Each document's spans and what stays of it."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, spans, kept = [], [], []
            for packed, runs in zip(batch.column("packed"), batch.column("runs")):
                text = unpack(packed.as_py())
                sizes.append(len(text))
                if not runs.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                places = runs.values.to_numpy(zero_copy_only=False)
                change = np.zeros(len(text) + 1, np.int64)
                first = np.minimum(places >> 21, len(text))
                np.add.at(change, first, 1)
                np.add.at(change, np.minimum(first + (places & ((1 << 21) - 1)) + width - 1, len(text)), -1)
                gone = np.cumsum(change)[:-1] > 0
                line = np.frombuffer(text, np.uint8)
                if whole_characters and len(line):
                    gone = _whole_characters(line, gone)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                kept.append(line[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield _batch(**{c: batch.column(c) for c in ("doc_id", *kept_fields)}, n_bytes=pa.array(sizes, pa.int64()), spans=pa.array(spans, kind), kept=pa.array(kept, pa.binary()))
            release()

    return run


def repeated_substrings(df: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                        whole_characters: bool = False) -> DataFrame:
    """doc_id, the columns `keep`, n_bytes, spans and kept (bytes that stay) for every row.

    Texts are UTF-8 bytes, null as empty. A byte goes when a string of `width` bytes over it also starts earlier: in a document with a smaller
    id, or before it in its own. Matches never cross documents and are judged on the input; spans are maximal runs. Ids are integers; null ids
    come last and, like repeated ids, count as one document, whose rows take nothing from each other at the same place; each row loses what
    repeats in its own text. Texts shorter than `width` stay whole. With `whole_characters` a character goes only with all its bytes, so that `kept` is UTF-8 again. Other columns may have any names.
    """
    plain = df.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), *[col(n).alias(f"_k{i}") for i, n in enumerate(keep)])
    plain = plain.withColumn("text_key", F.xxhash64("text"))  # with the id, a row's own key
    fields = [f"_k{i}" for i in range(len(keep))]
    types = dict(plain.dtypes)

    def pack(names: list[str]) -> DataFrame:
        def step(batches):
            squeeze = zstandard.ZstdCompressor(level=3).compress
            for batch in batches:
                for part in slices(batch):
                    packed = pa.array([squeeze(t.encode()) for t in part.column("text").to_pylist()], pa.binary())
                    yield _batch(**{c: part.column(c) for c in ("doc_id", "text_key", *names)}, packed=packed)

        source = plain.select("doc_id", "text_key", "text", *names)
        return source.mapInArrow(step, "doc_id bigint, text_key bigint, " + "".join(f"{n} {types[n]}, " for n in names) + "packed binary").withColumn("key_id", F.coalesce("doc_id", F.lit(NO_ID)))

    entries = plain.select("doc_id", "text_key", "text").mapInArrow(_anchor_rows(width), ANCHOR_ROWS).repartition("key")
    settled = cut_lineage(entries.sortWithinPartitions("kind", "key", "span", "doc_id", "run", "text_key").mapInArrow(_settle_spans, SETTLED_ROWS))
    open_ = settled.filter(F.col("kind") != COVER).groupBy(F.col("doc_id").alias("key_id"), "text_key").agg(F.collect_list(F.struct("kind", "key", "run")).alias("runs"))
    asked = pack([]).join(open_.hint("merge"), ["key_id", "text_key"]).select(F.col("key_id").alias("doc_id"), "text_key", "packed", "runs")
    refined = asked.mapInArrow(_refine_rows(width), REFINE_ROWS).repartition("key").sortWithinPartitions("kind", "key", "check", "doc_id", "run", "text_key")
    covers = settled.filter(F.col("kind") == COVER).select("doc_id", "run", "text_key").unionByName(refined.mapInArrow(_settle_windows(width), "doc_id bigint, run bigint, text_key bigint"))
    covers = covers.groupBy(F.col("doc_id").alias("key_id"), "text_key").agg(F.collect_list("run").alias("runs"))
    whole = pack(fields).join(covers.hint("merge"), ["key_id", "text_key"], "left").select("doc_id", *fields, "packed", "runs")
    schema = "doc_id bigint, " + "".join(f"{n} {types[n]}, " for n in fields) + "n_bytes bigint, spans array<struct<start:bigint,length:bigint>>, kept binary"
    out = whole.mapInArrow(_cut(width, fields, whole_characters), schema)
    return out.select("doc_id", *[F.col(f).alias(n) for f, n in zip(fields, keep)], "n_bytes", "spans", "kept")
