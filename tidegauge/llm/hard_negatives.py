"""Hard-negative mining over an inverted multi-index.

Rows are dealt into blocks of bounded size. Every block has two codebooks, one for each half of the dimensions, fitted on all rows of the
block; a pair of codewords is a cell, and the rows of a cell lie together. A codeword keeps how far its rows reach, a cell too.
For an anchor, a codeword bounds its half of the score by <half, codeword> + |half| * radius. The cells are visited by falling sums of two
such half bounds: a heap walks through the two sorted lists (multi-sequence), and a cell whose own radii exclude it is passed over. A window
of scores is certified, and the walk ends, when the next sum lies below the last place that the window still wants.
The first pass finds each anchor's positives in every block, the second the negatives in the windows that the merged positives set.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.llm.common import col, release
from tidegauge.llm.topk import best, blocks, meetings, products
from tidegauge.session import cut_lineage

#: Components of a block (rows by width), codewords of a half, rounds of fitting, rows that are scored together.
COMPONENTS, CODEWORDS, ROUNDS, TOGETHER = 1 << 19, 16, 5, 512
#: Scores beyond count as this, so that 100 times a score fits into 64 bits.
MOST = 1 << 55
#: Bounds grow by this share of what they are made of and by one: far more than their rounding.
MARGIN = 1e-9
KINDS = {"ids": "<i8", "labels": "<i8", "vectors": "<i8", "starts": "<i4", "codes1": "<f8", "codes2": "<f8", "reach1": "<f8", "reach2": "<f8", "cell1": "<f8", "cell2": "<f8"}


class Index(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray  # of the cells, by first and then second codeword
    codes1: np.ndarray
    codes2: np.ndarray
    reach1: np.ndarray  # radius of each codeword
    reach2: np.ndarray
    cell1: np.ndarray  # radii of each cell in both halves
    cell2: np.ndarray

    def cells(self) -> dict:
        return {k: [np.ascontiguousarray(v, KINDS[k]).tobytes()] for k, v in self._asdict().items()}

    @classmethod
    def of(cls, row: dict, width: int) -> Index:
        made = cls(**{k: np.frombuffer(row[k], kind) for k, kind in KINDS.items()})
        half = width // 2
        return made._replace(vectors=made.vectors.reshape(len(made.ids), width), codes1=made.codes1.reshape(len(made.reach1), half), codes2=made.codes2.reshape(len(made.reach2), width - half))


def codebook(half: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codewords, each row's codeword, each row's distance from it. Starts are far apart; the result depends on the rows alone."""
    distance = lambda c: ((half - c) ** 2).sum(1)
    codes = [half.mean(0)]
    far = distance(codes[0])
    while len(codes) < min(count, len(half)):
        codes.append(half[int(far.argmax())])
        far = np.minimum(far, distance(codes[-1]))
    codes = np.array(codes)
    for _ in range(ROUNDS):
        own = ((codes**2).sum(1) - 2 * half @ codes.T).argmin(1)
        size = np.bincount(own, minlength=len(codes))
        sums = np.stack([np.bincount(own, x, len(codes)) for x in half.T], 1) if half.shape[1] else np.zeros((len(codes), 0))
        codes[size > 0] = sums[size > 0] / size[size > 0, None]
    return codes, own, np.sqrt(((half - codes[own]) ** 2).sum(1))


def indexed(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, count: int = CODEWORDS) -> Index:
    """The inverted multi-index of a block with one row at least."""
    half = vectors.shape[1] // 2
    (codes1, own1, far1), (codes2, own2, far2) = (codebook(x.astype(float), count) for x in (vectors[:, :half], vectors[:, half:]))
    cell = own1 * len(codes2) + own2
    order = np.argsort(cell, kind="stable")
    size = np.bincount(cell, minlength=len(codes1) * len(codes2))

    def most(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, groups, values)
        return out

    return Index(ids[order], labels[order], vectors[order], np.append(0, np.cumsum(size)), codes1, codes2, most(own1, far1, len(codes1)), most(own2, far2, len(codes2)),
                 most(cell, far1, len(size)), most(cell, far2, len(size)))


def multi_sequence(first: np.ndarray, second: np.ndarray):
    """Pairs of places (i, j) with first[i] + second[j], largest sums first."""
    by1, by2 = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    high1, high2 = first[by1].tolist(), second[by2].tolist()
    heap, reached = [(-(high1[0] + high2[0]), 0, 0)], [0] * len(by1)
    while heap:
        total, a, b = heapq.heappop(heap)
        yield by1[a], by2[b], -total
        reached[a] = b + 1
        # A pair is open when both pairs before it, in either list, were given out.
        if a + 1 < len(by1) and reached[a + 1] == b:
            heapq.heappush(heap, (-(high1[a + 1] + high2[b]), a + 1, b))
        if b + 1 < len(by2) and (a == 0 or reached[a - 1] > b + 1):
            heapq.heappush(heap, (-(high1[a] + high2[b + 1]), a, b + 1))


def walk(q: np.ndarray, index: Index, wanted, take) -> int:
    """Scores of the rows that may reach `wanted()`, handed to `take(places, scores)` cell by cell, likeliest first. Gives the rows scored.

    `wanted()` is the lowest score of use just now; it only rises.
    """
    half = len(q) // 2
    parts = q[:half].astype(float), q[half:].astype(float)
    long1, long2 = (float(np.sqrt((x * x).sum())) for x in parts)
    size1, size2 = (np.sqrt((c * c).sum(1)) for c in (index.codes1, index.codes2))
    centre1, centre2 = index.codes1 @ parts[0], index.codes2 @ parts[1]
    slack1, slack2 = MARGIN * long1 * (size1 + index.reach1) + 1, MARGIN * long2 * (size2 + index.reach2) + 1
    starts, held, count, scored = index.starts, [], 0, 0

    def flush() -> None:
        nonlocal held, count, scored
        places = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in held])
        take(places, products(q[None], index.vectors[places], MOST)[0])
        held, count, scored = [], 0, scored + len(places)

    for i, j, total in multi_sequence(centre1 + long1 * index.reach1 + slack1, centre2 + long2 * index.reach2 + slack2):
        line = wanted()
        if max(total, -MOST) < line:
            break
        cell = i * len(index.codes2) + j
        n = int(starts[cell + 1] - starts[cell])
        if n and max(centre1[i] + long1 * index.cell1[cell] + slack1[i] + centre2[j] + long2 * index.cell2[cell] + slack2[j], -MOST) >= line:
            held.append(cell)
            count += n
            if count >= TOGETHER:
                flush()
    if held:
        flush()
    return scored


class Window(NamedTuple):
    """The `k` first rows by (score falling, id) with low <= score <= high."""

    low: int
    high: int
    k: int
    ids: list
    scores: list

    def line(self) -> int:
        return self.scores[-1] if len(self.scores) == self.k else self.low

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = np.flatnonzero((scores >= self.line()) & (scores <= self.high))
        if len(good):
            ids, scores = np.append(np.array(self.ids, np.int64), ids[good]), np.append(np.array(self.scores, np.int64), scores[good])
            first = best(ids, scores, self.k)
            self.ids[:], self.scores[:] = ids[first].tolist(), scores[first].tolist()


def score_range(positive: int, least: int, most: int) -> tuple[int, int]:
    """Lowest and highest whole score s with least * positive <= 100 * s <= most * positive."""
    return -(-least * positive // 100), most * positive // 100


def numeric(df: DataFrame, id_col: str, label_col: str | Column, vector_col: str, scale: int) -> DataFrame:
    """id, label, v (whole numbers) of the rows that take part, one per id."""
    v = col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = label_col if isinstance(label_col, Column) else col(label_col)
    rows = df.select(col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.when(finite, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))).alias("v"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def build_index(rows: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, int]:
    """The blocks' inverted multi-indexes as a table in the shared folder, and the number of blocks; rows of one width share a row of the table."""
    count = max(1, -(-(rows.agg(F.sum(F.size("v") + 1)).first()[0] or 0) // components))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, vectors = fields(batch.column("c_rows")[i].values, batch.column("width")[i].as_py())
                yield pa.RecordBatch.from_pydict({"c": batch.column("c").slice(i, 1), "width": batch.column("width").slice(i, 1)} | indexed(ids, labels, vectors).cells())
            release()

    return cut_lineage(blocks(rows, count, "c").mapInArrow(run, "c int, width int, " + ", ".join(f"{k} binary" for k in KINDS))), count


def fields(rows: pa.StructArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("id", "label"))
    return ids, labels, rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), width)


def over_index(index: DataFrame, count: int, anchors: DataFrame, per_block: int, step, schema: str) -> DataFrame:
    """`step(id, label, vector, index, other fields)` gives rows for every anchor and every block of its width."""
    sent = blocks(anchors, max(1, -(-anchors.count() // per_block)), "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                width, given = batch.column("width")[i].as_py(), batch.column("q_rows")[i].values
                held = Index.of({k: batch.column(k)[i].as_py() for k in KINDS}, width)
                more = [given.field(f.name).to_pylist() for f in given.type if f.name not in ("id", "label", "v")]
                out = [r for own in zip(*fields(given, width), *more) for r in step(held, int(own[0]), int(own[1]), *own[2:])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)
            release()

    return meetings(sent, index).mapInArrow(run, schema)


def hard_negatives(df: DataFrame, anchors, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256, id_col: str = "vec_id",
                   label_col: str | Column = "label", vector_col: str = "embedding", components: int = COMPONENTS, anchor_block: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors` makes a condition from the id column. A row's score is its whole-number inner product with the anchor (components x count as
    floor(scale * x), in 64 bits); higher scores come first, ties by smaller id. An anchor's positives are its first other rows with its label; for
    each, the first rows of another label with least * positive <= 100 * score <= most * positive are its negatives. Fewer candidates give
    fewer rows. Labels are whole numbers. Rows without an id, label or vector, or with a component that is null or not finite, take no part; of rows that
    share an id one stays, the smallest by label and vector. Vectors meet those of their own width only. Scores beyond 2**55 count as 2**55.
    """
    rows = cut_lineage(numeric(df, id_col, label_col, vector_col, scale))
    index, count = build_index(rows, components)
    asked = rows.filter(anchors(F.col("id")))

    def nearest(held, own, label, q):
        found = Window(-MOST, MOST, positives, [], [])

        def take(places, scores):
            same = (held.labels[places] == label) & (held.ids[places] != own)
            found.add(held.ids[places][same], scores[same])

        walk(q, held, found.line, take)
        return [(own, i, s) for i, s in zip(found.ids, found.scores)]

    by_anchor = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = over_index(index, count, asked, anchor_block, nearest, "anchor_id bigint, positive_id bigint, positive_score bigint")
    near = near.withColumn("rank", F.row_number().over(by_anchor)).filter(F.col("rank") <= positives)
    pairs = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # at most `positives`
    told = cut_lineage(asked.join(pairs, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "positives"))

    def mined(held, own, label, q, pairs):
        ranges = {p["positive_score"]: score_range(p["positive_score"], least, most) for p in pairs}
        windows = {s: Window(low, high, negatives, [], []) for s, (low, high) in ranges.items() if low <= high}
        if not windows:
            return []

        def take(places, scores):
            other = held.labels[places] != label
            for window in windows.values():
                window.add(held.ids[places][other], scores[other])

        walk(q, held, lambda: min(w.line() for w in windows.values()), take)
        return [(own, p["positive_id"], p["positive_score"], i, s) for p in pairs if (w := windows.get(p["positive_score"])) for i, s in zip(w.ids, w.scores)]

    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    by_pair = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = over_index(index, count, told, anchor_block, mined, schema).withColumn("rank", F.row_number().over(by_pair)).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
