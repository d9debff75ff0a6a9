"""Near-duplicates by one-permutation MinHash with optimal densification.

Texts are sets of word shingles. Equal sets form one class by a 128-bit digest, and only the smallest id of a class goes on. One
permutation deals a set's shingles over BINS bins and keeps each bin's least; an empty bin borrows from the first
filled one in its own random order of bins. Bands of ROWS bins make buckets. A bucket links its members to its smallest id only, a
star, so candidate pairs are fewer than bucket entries. Links are confirmed on the full sets, and components are found.
Two members may resemble each other and not the centre of the star. So what buckets with several components hold together is compared
block by block, inside tasks: common shingles are counted for all pairs of two blocks, and the links between different components join the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import col, map_slices, texts
from tidegauge.llm.components import connected_components
from tidegauge.llm.hashing import SpanHasher, mix
from tidegauge.session import cut_lineage

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Sets and shingles of a block that meets others in one task.
BLOCK_SETS, BLOCK_SHINGLES = 256, 200_000
#: Common shingles of two blocks that are counted together.
TOGETHER = 8192
BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
#: For each bin the order in which it looks at the others; fixed by its seed.
BORROW = np.argsort(np.random.default_rng(20240229).random((BINS, BINS)), axis=1)
#: Odd numbers picked freely.
STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True


def shingle_hashes(batch: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all distinct k-word shingles, in that order. Fewer words are one shingle; no words, none."""
    raw = [t.encode().lower() for t in batch]  # of bytes, only A-Z have a lower case
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    size = np.array([len(r) + 1 for r in raw], np.int64)
    white = _white[data]
    before = np.append(True, white[:-1])
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
    word = SpanHasher(data)(starts, ends)
    text = np.searchsorted(np.cumsum(size), starts, "right")
    words = np.bincount(text, minlength=len(batch))
    first = np.cumsum(words) - words
    left = words[text] - (np.arange(len(text)) - first[text])  # words from here to the text's end
    code = np.zeros(len(word), np.uint64)
    for i in range(k):
        take = np.flatnonzero(left > i) if i else np.arange(len(word))
        code[take] = code[take] * STEPS[0] + mix(word[take + i] + STEPS[1])
    here = (left >= k) | ((words[text] < k) & (left == words[text]))
    short = words[text] < k
    code[short] += STEPS[2] * words[text][short].astype(np.uint64)
    text, code = text[here], mix(code[here])
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
    return text[new], code[new]


def one_permutation(text: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """BINS values of each set, from sorted (text, code); sets must not be empty."""
    bin_ = (code >> BIN_SHIFT).astype(np.int64)
    least = np.ones(len(text), bool)
    least[1:] = (text[1:] != text[:-1]) | (bin_[1:] != bin_[:-1])
    values, filled = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    values[text[least], bin_[least]] = code[least]
    filled[text[least], bin_[least]] = True
    gaps = np.flatnonzero(~filled.all(1) & filled.any(1))
    own, had = values[gaps], filled[gaps]
    for j in range(BINS):
        lender = BORROW[j][had[:, BORROW[j]].argmax(1)]
        values[gaps, j] = np.where(had[:, j], own[:, j], own[np.arange(len(gaps)), lender])
    return values


def signatures(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set (d1, d2) and its band keys."""

    def step(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        text, code = shingle_hashes(batch.column("text").to_pylist(), k)
        count = np.bincount(text, minlength=n)
        digest = np.zeros((2, n), np.uint64)
        for row, step_ in zip(digest, STEPS):
            np.add.at(row, text, mix(code ^ step_))
        values = one_permutation(text, code, n)
        keys = np.zeros((n, BANDS), np.uint64)
        for r in range(ROWS):
            keys = keys * STEPS[0] + mix(values[:, r::ROWS] + STEPS[1])
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * STEPS[2]).view(np.int64)
        keys = keys[count > 0]
        offsets = np.append(0, np.cumsum(np.where(count > 0, BANDS, 0)))
        bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.reshape(-1)))
        return {"doc_id": batch.column("doc_id"), "n_shingles": pa.array(count, pa.int64()), "d1": digest[0].view(np.int64), "d2": digest[1].view(np.int64), "bands": bands}

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(texts(df, id_col, text_col), step, f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")


def shingle_set(text: bytes, k: int) -> frozenset:
    words = text.lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(k))))


def confirmed(pairs: DataFrame, packed: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least `percent` of their union in common."""
    kind = pairs.schema["a"].dataType.simpleString()
    # Sorted by a, the centre, whose set is then made once for its pairs.
    both = pairs.join(packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("pb")).hint("merge"), "b")
    both = both.join(packed.select(F.col("doc_id").alias("a"), F.col("packed").alias("pa")).hint("merge"), "a").select("a", "b", "pa", "pb")

    def run(batches):
        unpack, last, centre = zstandard.ZstdDecompressor().decompress, None, frozenset()
        for batch in batches:
            hits = []
            for pa_, pb_ in zip(batch.column("pa"), batch.column("pb")):
                pa_ = pa_.as_py()
                if pa_ != last:
                    last, centre = pa_, shingle_set(unpack(pa_), k)
                other = shingle_set(unpack(pb_.as_py()), k)
                common = len(centre & other)
                hits.append(100 * common >= percent * (len(centre) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def packed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the compressed text, which is what moves when sets are confirmed."""

    def step(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=3).compress
        return {"doc_id": batch.column("doc_id"), "packed": pa.array([pack(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())}

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(texts(df, id_col, text_col), step, f"doc_id {kind}, packed binary")


def common_shingles(text: np.ndarray, code: np.ndarray, left: int, count: int) -> np.ndarray:
    """How many hashed shingles each of the first `left` texts has in common with each of the others, from distinct (text, hash)."""
    first = text < left
    shared = np.intersect1d(code[first], code[~first])
    place = np.searchsorted(shared, code)
    held = place < len(shared)
    held[held] = shared[place[held]] == code[held]
    out = np.zeros((left, count - left), np.int64)
    text, place = text[held], place[held]
    order = np.argsort(place, kind="stable")
    text, place = text[order], place[order]
    for start in range(0, len(shared), TOGETHER):
        a, b = np.searchsorted(place, [start, start + TOGETHER])
        has = np.zeros((count, min(TOGETHER, len(shared) - start)), np.float32)
        has[text[a:b], place[a:b] - start] = 1
        out += (has[:left] @ has[left:].T).astype(np.int64)
    return out


def links_within_families(mixed: DataFrame, packed: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between rows (rep, n_shingles, component, centre) that a chain of buckets holds together.

    A family is dealt over size classes and, within them, over blocks of a bounded number of shingles. Sets that are alike enough are at
    most one class apart, so each block meets the blocks of its class and of the next one. Pairs live only inside a task; what
    leaves it are links.
    """
    family = connected_components(mixed.select(F.col("rep").alias("a"), F.col("centre").alias("b")))
    rows = mixed.select("rep", "n_shingles", F.col("component").alias("own")).distinct().join(family, F.col("rep") == F.col("node"))
    rows = rows.select("rep", "n_shingles", "own", F.col("component").alias("family"))
    classes = F.floor(F.log("n_shingles") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    rows = rows.withColumn("size_class", classes)
    shape = rows.groupBy("family", "size_class").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    shape = shape.select("family", "size_class", F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = rows.join(shape, ["family", "size_class"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    kind = packed.schema["doc_id"].dataType.simpleString()
    rows = rows.join(packed.select(F.col("doc_id").alias("rep"), "packed").hint("merge"), "rep")
    blocks = rows.groupBy("family", "size_class", "block").agg(F.collect_list(F.struct("rep", "own", "n_shingles", "packed")).alias("sets"))
    place = ["family", "size_class", "block"]
    # One row per meeting of two blocks: block numbers only.
    named = shape.select("family", "size_class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    near = named.withColumn("other_class", F.explode(F.array("size_class", F.col("size_class") + 1)))
    partner = shape.select("family", F.col("size_class").alias("other_class"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_block"))
    grid = near.join(partner, ["family", "other_class"]).filter("other_class > size_class OR other_block >= block")
    theirs = blocks.select("family", F.col("size_class").alias("other_class"), F.col("block").alias("other_block"), F.col("sets").alias("other_sets"))
    met = grid.join(blocks, place).join(theirs, ["family", "other_class", "other_block"]).select("sets", "other_sets")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (batch.column(c)[i].values for c in ("sets", "other_sets"))
                ids, own, n, raw = (pa.concat_arrays([left.field(f), right.field(f)]) for f in ("rep", "own", "n_shingles", "packed"))
                # A block that meets itself is listed twice; a pair of one id is in one component and falls out.
                raw = [unpack(x.as_py()) for x in raw]
                n, (_, own) = n.to_numpy(zero_copy_only=False), np.unique(own.to_numpy(zero_copy_only=False), return_inverse=True)
                common = common_shingles(*shingle_hashes([r.decode() for r in raw], k), len(left), len(raw))
                sizes = n[: len(left), None] + n[None, len(left) :]
                sets: dict[int, frozenset] = {}
                hits = []
                for x, z in np.argwhere((100 * common >= percent * (sizes - common)) & (own[: len(left), None] != own[None, len(left) :])).tolist():
                    z += len(left)
                    if own[z] == own[x]:
                        continue
                    for j in (x, z):
                        if j not in sets:
                            sets[j] = shingle_set(raw[j], k)
                    both = len(sets[x] & sets[z])
                    if 100 * both >= percent * (len(sets[x]) + len(sets[z]) - both):
                        hits.append((x, z))
                        own[own == own[z]] = own[x]
                a, b = (pa.array([h[e] for h in hits], pa.int64()) for e in (0, 1))
                yield pa.RecordBatch.from_pydict({"a": ids.take(a), "b": ids.take(b)})

    return met.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z. Texts with 100 * common >= percent * union of their
    shingle sets are linked. component_id is the smallest id that can be reached; that row is kept. Null and empty texts and texts without words
    have an empty set and are linked with nothing, as are rows with a null id. Rows that share an id count as one document.
    The recall of the buckets for one pair at 80 percent is 1 - (1 - 0.8 ** 4) ** 32, all but 5e-8.
    """
    marked = cut_lineage(signatures(df, shingle, id_col, text_col))
    key = ["d1", "d2", "n_shingles"]
    linked = marked.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = cut_lineage(linked.select("doc_id", "n_shingles", "d1", "d2", "bands").join(classes, key)
                          .select("doc_id", "rep", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")))
    entries = members.filter("bands IS NOT NULL").select("rep", "n_shingles", F.explode("bands").alias("band"))
    packed = packed_texts(df, id_col, text_col)

    def alike(n: str, m: str):
        """What the sizes of two sets allow."""
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    centres = entries.groupBy("band").agg(F.min(F.struct("rep", "n_shingles")).alias("c"), F.max("rep").alias("last")).filter("c.rep <> last")
    stars = entries.join(centres.select("band", F.col("c.rep").alias("a"), F.col("c.n_shingles").alias("m")), "band").filter("rep <> a")
    stars = cut_lineage(stars.filter(alike("n_shingles", "m")).select("a", F.col("rep").alias("b")).distinct())
    links = cut_lineage(confirmed(stars, packed, shingle, percent))
    found = cut_lineage(connected_components(links))

    # Buckets with several components: members are compared across components, family by family.
    placed = entries.join(found, F.col("rep") == F.col("node"), "left").select("rep", "n_shingles", "band", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("centre")).filter("lo <> hi")
    mixed = cut_lineage(placed.join(mixed.select("band", "centre"), "band").select("rep", "n_shingles", "component", "centre").distinct())
    more = cut_lineage(links_within_families(mixed, packed, shingle, percent))
    if not more.isEmpty():
        # The components found so far are stars already; only what the new links touch changes.
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = cut_lineage(connected_components(stars.unionByName(more)))

    ids = members.select("doc_id", "rep").distinct().join(found, F.col("rep") == F.col("node"), "left")
    ids = ids.select("doc_id", F.coalesce("component", "rep").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = marked.select("doc_id", "n_shingles").join(ids, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, one of each component, with all their columns."""
    gone = near_duplicates(df, shingle, percent, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone.hint("merge"), col(id_col) == F.col("_gone"), "left_anti")
