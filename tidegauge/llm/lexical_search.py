"""Exact ranked lexical search over sparse ball trees.

A document is a sparse vector of whole numbers d[t] over the items' terms, an item a set of terms with weights w[t]; the score is the inner product,
the sum of w[t] * d[t]. Documents are dealt into trees of bounded size. A tree is split from the top by two far-apart
documents, halves of equal size, down to small leaves. All of a tree lives in a space scaled by sqrt(w), so that frequent terms count little.
A node keeps its centroid and, for each band of terms, the radius: how far the node's documents reach above the centroid.
    score(item, document) <= <item, centroid> + sum over bands of |item in the band| * radius
With one band this is the plain ball, which excludes next to nothing in a sparse space; up to BANDS terms have a band each.
Bounds are floating point, enlarged by more than their rounding can take away; leaves are scored in 64-bit integers.
Subtrees are visited best-first, until the next bound is below the k-th best score. A first pass looks at a few leaves of each tree only: the k-th best of
what it finds is a cutoff that holds for all trees, and the second pass prunes with it.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.llm.common import ascii_lower, col, release, slices, texts
from tidegauge.llm.decontamination import WORD, words_of
from tidegauge.session import cut_lineage

#: Bytes of different terms of the items that are searched together, unless one item alone has more.
BLOCK_BYTES = 1 << 20
#: Documents and vector entries of a tree, documents of a leaf, bands of terms.
TREE_ROWS, TREE_ENTRIES, LEAF, BANDS = 4096, 1 << 20, 32, 8192
#: Bytes of text that are tokenized together.
SLICE = 1 << 21
#: Floating-point bounds grow by this share and by one: far more than the rounding of sums of a million terms.
MARGIN = 1e-9
#: Stands for a missing document id, so that it is last among equal scores.
NO_ID = (1 << 63) - 1
LOWEST = 0


class Queries(NamedTuple):
    """A block of items: flat term numbers, where each item's terms start, whole weights of all terms."""

    terms: np.ndarray
    starts: np.ndarray
    weights: np.ndarray

    @property
    def count(self) -> int:
        return len(self.starts) - 1


def vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all terms with repeats), terms and tfs (of the vocabulary) of every document with a term."""
    known = pa.array(vocabulary, pa.binary())

    def run(batches):
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                words, n_words = words_of(piece.column("text").cast(pa.binary()).to_pylist())
                coded = words.dictionary_encode()
                number = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(n_words)), n_words)
                has = term >= 0
                key, tf = np.unique(row[has] * len(vocabulary) + term[has], return_counts=True)
                row, term = np.divmod(key, max(1, len(vocabulary)))
                some = np.flatnonzero(n_words)
                cuts = pa.array(np.append(np.searchsorted(row, some), len(row)), pa.int32())
                cell = lambda x: pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32()))  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id").take(pa.array(some)), "n": pa.array(n_words[some], pa.int64()), "terms": cell(term), "tfs": cell(tf)})
            release()

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


KINDS = {"ids": "<i8", "ends": "<i8", "terms": "<i4", "values": "<i4", "nodes": "<i4", "cuts": "<i8", "bands": "<i4", "radii": "<f8"}


class Tree(NamedTuple):
    ids: np.ndarray
    ends: np.ndarray  # of each document's entries, after a 0
    terms: np.ndarray
    values: np.ndarray
    nodes: np.ndarray  # first and last document, left and right child (0: leaf)
    cuts: np.ndarray  # where each node's bands and radii end, after a 0
    bands: np.ndarray
    radii: np.ndarray

    def cells(self) -> dict:
        """A row of the table of trees."""
        return {k: [np.ascontiguousarray(v, KINDS[k]).tobytes()] for k, v in self._asdict().items()}

    @classmethod
    def of(cls, row: dict) -> Tree:
        made = cls(**{k: np.frombuffer(row[k], kind) for k, kind in KINDS.items()})
        return made._replace(nodes=made.nodes.reshape(-1, 4), terms=made.terms.astype(np.int64), values=made.values.astype(np.int64))


def picked(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some rows, one row after the other, and the rows' ends there."""
    sizes = ends[rows + 1] - ends[rows]
    stops = np.cumsum(sizes)
    return np.arange(stops[-1]) + np.repeat(ends[rows] - (stops - sizes), sizes), np.append(0, stops)


def grow(ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, root: np.ndarray, band: np.ndarray, leaf: int = LEAF) -> Tree:
    """A ball tree over documents with one entry at least. `root` is sqrt(w) of every term, `band` its band."""
    scaled, several = values * root[terms], len(np.unique(band)) < len(band)
    nodes, reaches, order, waiting = [], [], np.arange(len(ids)), [(0, len(ids), -1, 0)]
    while waiting:
        lo, hi, parent, side = waiting.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][side] = number
        rows = order[lo:hi]
        at, cut = picked(ends, rows)
        t, x = terms[at], scaled[at]
        centre = np.bincount(t, x, len(root)) / len(rows)
        above = np.maximum(x - centre[t], 0)
        own = band[t]
        if several:  # the length of each document's part in each band
            part, place = np.unique(np.repeat(np.arange(len(rows)), np.diff(cut)) * len(band) + own, return_inverse=True)
            own, above = part % len(band), np.sqrt(np.bincount(place, above * above))
        reach = np.zeros(len(band))
        np.maximum.at(reach, own, above)
        nodes.append([lo, hi, 0, 0])
        reaches.append((np.flatnonzero(reach), reach[reach > 0]))
        if hi - lo <= leaf:
            continue
        dot = lambda dense: np.add.reduceat(x * dense[t], cut[:-1])  # noqa: B023, E731
        square = np.add.reduceat(x * x, cut[:-1])

        def dense(i: int) -> np.ndarray:
            return np.bincount(t[cut[i] : cut[i + 1]], x[cut[i] : cut[i + 1]], len(root))  # noqa: B023

        one = dense(int(np.argmax(square - 2 * dot(centre))))
        to_one = dot(one)
        other = dense(int(np.argmax(square - 2 * to_one)))
        order[lo:hi] = rows[np.argsort(to_one - dot(other), kind="stable")]
        middle = (lo + hi) // 2
        waiting += [(middle, hi, number, 3), (lo, middle, number, 2)]
    at, cut = picked(ends, order)
    cuts = np.append(0, np.cumsum([len(x) for x, _ in reaches]))
    return Tree(ids[order], cut, terms[at], values[at], np.array(nodes, np.int32), cuts, *(np.concatenate(x) for x in zip(*reaches)))


def bounds(tree: Tree, queries: Queries, root: np.ndarray, band: np.ndarray) -> np.ndarray:
    """A safe upper bound of the score of every node (row) and item (column)."""
    item = np.repeat(np.arange(queries.count), np.diff(queries.starts))
    part, place = np.unique(item * len(band) + band[queries.terms], return_inverse=True)
    owner, its_band = np.divmod(part, len(band))
    length = np.sqrt(np.bincount(place, queries.weights[queries.terms]))
    out, scaled = np.zeros((len(tree.nodes), queries.count)), tree.values * root[tree.terms]
    reach = np.zeros(len(band))
    for node, (lo, hi, *_) in enumerate(tree.nodes.tolist()):
        a, b = tree.ends[lo], tree.ends[hi]
        centre = np.bincount(tree.terms[a:b], scaled[a:b], len(root)) / (hi - lo)
        own = tree.bands[tree.cuts[node] : tree.cuts[node + 1]]
        reach[own] = tree.radii[tree.cuts[node] : tree.cuts[node + 1]]
        out[node] = np.bincount(item, centre[queries.terms] * root[queries.terms], queries.count) + np.bincount(owner, length * reach[its_band], queries.count)
        reach[own] = 0
    return out * (1 + MARGIN) + 1


class Best:
    """The k best (score, id) of each item so far; scores below `floor` are of no use."""

    def __init__(self, count: int, k: int, floor: np.ndarray):
        self.k, self.line = k, floor.copy()
        self.scores, self.ids = [np.zeros(0, np.int64)] * count, [np.zeros(0, np.int64)] * count

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = np.flatnonzero((scores >= self.line[item]) & (scores > LOWEST))
        if not len(good):
            return
        scores, ids = np.append(self.scores[item], scores[good]), np.append(self.ids[item], ids[good])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[first], ids[first]
        if len(first) == self.k:
            self.line[item] = max(self.line[item], int(self.scores[item][-1]))


def search(tree: Tree, queries: Queries, root: np.ndarray, band: np.ndarray, best: Best, leaves: int | None) -> int:
    """Best-first through one tree for every item; `leaves` ends it early. Gives the number of documents scored."""
    bound, nodes, scored = bounds(tree, queries, root, band), tree.nodes.tolist(), 0
    weight = np.zeros(len(root), np.int64)
    for item in np.flatnonzero(bound[0] >= np.maximum(best.line, 1)).tolist():
        own = queries.terms[queries.starts[item] : queries.starts[item + 1]]
        weight[own] = queries.weights[own]
        limit, seen, heap = bound[:, item].tolist(), 0, [(-bound[0, item], 0)]
        while heap and -heap[0][0] >= best.line[item]:
            above, node = heapq.heappop(heap)
            lo, hi, left, right = nodes[node]
            if left:
                for child in (left, right):
                    if limit[child] >= best.line[item]:
                        heapq.heappush(heap, (max(above, -limit[child]), child))
                continue
            a, b = tree.ends[lo], tree.ends[hi]
            best.add(item, tree.ids[lo:hi], np.add.reduceat(tree.values[a:b] * weight[tree.terms[a:b]], tree.ends[lo:hi] - a))
            seen, scored = seen + 1, scored + hi - lo
            if seen == leaves:
                break
        weight[own] = 0
    return scored


def trees(rows: DataFrame, weights: np.ndarray, band: np.ndarray, documents: int, length: int) -> DataFrame:
    """One row per ball tree over the documents' vectors, as a table in the shared folder. Documents without a weighted term score 0 and are in no tree."""
    root = np.sqrt(weights)

    def grown(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        terms, tf = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in ("terms", "tfs"))
        m = np.array([10 + 90 * n * documents // length for n in batch.column("n").to_pylist()], np.int64)
        values = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_pydict(grow(ids, np.append(0, np.cumsum(sizes)), terms, values, root, band).cells())

    def run(batches):
        held, count, entries = [], 0, 0
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                past = sizes[at - 1] if at else 0
                n = min(TREE_ROWS - count, max(1, int(np.searchsorted(sizes, past + TREE_ENTRIES - entries, "right")) - at), batch.num_rows - at)
                held.append(batch.slice(at, n))
                at, count, entries = at + n, count + n, entries + int(sizes[at + n - 1] - past)
                if count == TREE_ROWS or entries >= TREE_ENTRIES:
                    yield grown(held)
                    held, count, entries = [], 0, 0
        if held:
            yield grown(held)
        release()

    weighted = F.array(*[F.lit(int(t)) for t in np.flatnonzero(weights == 0)]) if (weights == 0).any() else None
    rows = rows.filter(F.size("terms") > 0 if weighted is None else F.size(F.array_except("terms", weighted)) > 0)
    return cut_lineage(rows.mapInArrow(run, ", ".join(f"{k} binary" for k in KINDS)))


def search_all(forest: DataFrame, queries: Queries, band: np.ndarray, k: int, floor: np.ndarray, leaves: int | None) -> DataFrame:
    """item, doc_id, score: each task's k best of every item over its trees, none below the item's floor."""
    root = np.sqrt(queries.weights)

    def run(batches):
        best = Best(queries.count, k, floor)
        for batch in batches:
            for i in range(batch.num_rows):
                search(Tree.of({name: batch.column(name)[i].as_py() for name in batch.schema.names}), queries, root, band, best, leaves)
        item = np.repeat(np.arange(queries.count), [len(x) for x in best.ids])
        yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": np.concatenate([*best.ids, np.zeros(0, np.int64)]), "score": np.concatenate([*best.scores, np.zeros(0, np.int64)])})
        release()

    return forest.mapInArrow(run, "item int, doc_id bigint, score bigint")


def search_block(docs: DataFrame, pairs, k: int, probe: int, id_col: str, text_col: str) -> DataFrame:
    """item (number), rank, doc_id, score for one bounded block of (item number, term) pairs."""
    vocabulary, terms = np.unique(np.array(pairs["term"], object), return_inverse=True)
    starts = np.append(0, np.cumsum(np.bincount(pairs["item"])))
    order = np.lexsort((terms, pairs["item"]))
    rows = cut_lineage(vectors(docs, [t.encode() for t in vocabulary], id_col, text_col))
    documents, length = rows.agg(F.count("*"), F.sum("n")).first()
    found = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row per term of the block
    df = np.zeros(len(vocabulary))
    df[[r["term"] for r in found]] = [r["count"] for r in found]
    weights = np.where(df > 0, np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))), 0).astype(np.int64)
    # Terms beyond the number of bands share them evenly, frequent with rare ones.
    band = np.empty(len(df), np.int64)
    band[np.argsort(-df, kind="stable")] = np.arange(len(df)) % BANDS
    queries = Queries(terms[order], starts, weights)
    forest = trees(rows, weights, band, documents, length or 1)
    by_item = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")

    def ranked(floor: np.ndarray, leaves: int | None) -> DataFrame:
        return search_all(forest, queries, band, k, floor, leaves).withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= k)

    floor = np.zeros(queries.count, np.int64)
    for r in ranked(floor, probe).filter(F.col("rank") == k).collect():  # one row per item of the block
        floor[r["item"]] = r["score"]
    return ranked(floor, None)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, probe: int = 2, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0, equal scores by ascending doc_id.

    Document ids are whole numbers; a missing one is last among equals. Rows that share a document id are documents of their own; rows
    that share an item id are one item with the terms of all. Null and empty texts have no terms: such a document does
    not count, such an item has no rows. Empty tables give no rows. Items are searched in blocks of bounded size.
    """
    words = F.regexp_extract_all(ascii_lower(col(item_text_col)), F.lit(WORD), F.lit(0))
    pairs = cut_lineage(items.select(col(item_id_col).alias("item_id"), F.explode(words).alias("term")).distinct())
    size = pairs.agg(F.sum(F.octet_length("term") + 1)).first()[0] or 0
    count, spark = -(-size // block_bytes), items.sparkSession
    kind = items.schema[item_id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    documents = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text"))
    for i in range(count):
        block = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == i)
        ids = [r[0] for r in block.select("item_id").distinct().collect()]
        if not ids:
            continue
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, name {kind}")
        own = block.join(F.broadcast(names), F.col("item_id").eqNullSafe(F.col("name"))).select("item", "term").toPandas()
        found = search_block(documents, own, k, probe, "doc_id", "text").join(F.broadcast(names), "item")
        out = out.unionAll(found.select(F.col("name").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"))
    return out
