"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions form `lists` groups; the score of a pair is the sum of its groups' partial scores. Candidates are dealt over
blocks, and every block meets every block of queries.
1. Each block ranks its candidates by every list and gathers, per query, the k best exact scores among the list heads.
2. The k-th best of all that was gathered is a safe cutoff and goes back to the blocks. A candidate that reaches the cutoff
   has a partial score of at least cutoff / lists in some list; these entries are sufficient.
3. Their remaining partial scores are added exactly, and those at or above the cutoff are ranked.
Rows between the phases are a few per query and block, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.llm.common import col
from tidegauge.session import cut_lineage

HEADS = "query_id bigint, vec_id bigint, score bigint"
LOWEST = -(1 << 63)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and whole-number vector of every row whose vector is not null and holds finite numbers only."""
    v = col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return df.filter(v.isNotNull() & finite).select(col(id_col).cast("bigint").alias("id"), whole.alias("v"))


def blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
    """Rows dealt over `count` blocks by a hash of the id: one row per block and width, with its rows as a list."""
    dealt = rows.select(F.pmod(F.xxhash64("id", F.lit(name)), F.lit(count)).cast("int").alias(name), F.size("v").alias("width"),
                        F.struct(*rows.columns).alias("row"))
    return dealt.groupBy(name, "width").agg(F.collect_list("row").alias(name + "_rows"))


def meetings(sent: DataFrame, given: DataFrame) -> DataFrame:
    """Blocks that share a block number and a width, by a sort-merge join.

    What Spark estimates for `sent` leaves out that its rows were copied for every block. Without the hint these copies could be taken for
    a small table, and all of them would be gathered by the driver to be broadcast.
    """
    return sent.join(given.hint("merge"), ["c", "width"])


def products(queries: np.ndarray, candidates: np.ndarray, most: int = 1 << 60) -> np.ndarray:
    """Inner products, exact up to `most`; larger ones count as `most`, smaller than -most as that. Floating point only where every sum is below 2**53."""
    width = max(1, queries.shape[1])
    high_q, high_c = (np.abs(x.astype(float)).max(axis=1, initial=0) for x in (queries, candidates))
    top = high_q.max(initial=0) * high_c.max(initial=0) * width
    if top < 1 << 53:
        return (queries.astype(float) @ candidates.astype(float).T).astype(np.int64)
    if top < most / 2:
        return queries @ candidates.T
    # Numbers that 64 bits may not hold: the few rows that have them go through whole numbers of any size.
    line = (most / 4 / width) ** 0.5
    out = np.empty((len(queries), len(candidates)), np.int64)
    for q in (high_q <= line, high_q > line):
        for c in (high_c <= line, high_c > line):
            if q.any() and c.any():
                if high_q[q].max() <= line and high_c[c].max() <= line:
                    part = queries[q] @ candidates[c].T
                else:
                    part = np.clip(queries[q].astype(object) @ candidates[c].T.astype(object), -most, most).astype(np.int64)
                out[np.ix_(q, c)] = part
    return out


def unpacked(rows: pa.StructArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fields of a block's rows, and its vectors as a matrix."""
    fields = {f.name: rows.field(f.name) for f in rows.type if f.name != "v"}
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return {k: v.to_numpy(zero_copy_only=False) for k, v in fields.items()}, flat.reshape(len(rows), -1)


def over_grid(grid: DataFrame, step) -> DataFrame:
    """`step(query fields, query vectors, candidate ids, candidate vectors)` for every meeting of two blocks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked, q = unpacked(batch.column("q_rows")[i].values)
                given, c = unpacked(batch.column("c_rows")[i].values)
                found = step(asked, q, given["id"], c)
                if found:
                    queries, ids, scores = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_pydict({"query_id": queries, "vec_id": ids, "score": scores})

    return grid.mapInArrow(run, HEADS)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        line = np.partition(scores, len(ids) - k)[len(ids) - k]
        some = np.flatnonzero(scores >= line)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))


def top_k(df: DataFrame, queries, k: int = 10, scale: int = 1024, lists: int = 4, id_col: str = "vec_id", vector_col: str = "embedding",
          block: int = 8192, query_block: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k highest inner products with all other rows.

    `queries` makes a condition from the id column. Components x count as floor(scale * x); vectors that are null or hold null or non-finite
    components take no part, and vectors meet only vectors of their own width (empty ones score 0). Ties go to the smaller id. A
    query is not its own candidate: rows that repeat its id are left out too. Fewer than k candidates give fewer rows. Components beyond 64 bits count
    as the nearest 64-bit number, and a list's partial score beyond 2**60 as 2**60.
    """
    rows = cut_lineage(quantised(df, id_col, vector_col, scale).dropDuplicates(["id", "v"]))
    asked = rows.filter(queries(F.col("id")))
    # The numbers of blocks follow from the numbers of rows, so a block is bounded whatever the table holds.
    block_count, query_blocks = (max(1, -(-n // size)) for n, size in ((rows.count(), block), (asked.count(), query_block)))
    given = blocks(rows, block_count, "c")

    def grid(query_rows: DataFrame) -> DataFrame:
        """Every query block is sent to every candidate block, as a join on the candidate block's number."""
        sent = blocks(query_rows, query_blocks, "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(block_count - 1))))
        return meetings(sent, given).select("q_rows", "c_rows")

    def parts(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        edges = np.linspace(0, q.shape[1], lists + 1).astype(int)
        return [products(q[:, a:b], c[:, a:b]) for a, b in zip(edges[:-1], edges[1:])]

    def heads(asked, q, ids, c):
        partial = parts(q, c)
        total, found = sum(partial), []
        for i, own in enumerate(asked["id"]):
            others = np.flatnonzero(ids != own)
            first = np.unique(np.concatenate([others[best(ids[others], p[i][others], k)] for p in partial]))
            first = first[best(ids[first], total[i][first], k)]
            found.append((np.full(len(first), own), ids[first], total[i][first]))
        return found

    by_query = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    gathered = over_grid(grid(asked), heads).withColumn("rank", F.row_number().over(by_query))
    cutoff = gathered.filter(F.col("rank") <= k).groupBy("query_id").agg(
        F.max_by("score", "rank").alias("cut"), F.max_by("vec_id", "rank").alias("cut_id"), F.max("rank").alias("n"))
    full = F.col("n") == k
    told = asked.join(cutoff, F.col("id") == F.col("query_id"), "left").select(
        "id", "v", F.when(full, F.col("cut")).otherwise(F.lit(LOWEST)).alias("cut"), F.when(full, F.col("cut_id")).otherwise(F.lit(0)).alias("cut_id"))

    def sufficient(asked, q, ids, c):
        partial, found = parts(q, c), []
        for i, (own, cut, cut_id) in enumerate(zip(asked["id"], asked["cut"], asked["cut_id"])):
            # The threshold of one list, rounded down to a whole number.
            enough = np.flatnonzero((ids != own) & np.any([p[i] >= cut // lists for p in partial], axis=0))
            score = sum(p[i][enough] for p in partial)
            stays = (score > cut) | ((score == cut) & (ids[enough] <= cut_id))
            found.append((np.full(int(stays.sum()), own), ids[enough[stays]], score[stays]))
        return found

    resolved = over_grid(grid(told), sufficient).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = resolved.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
