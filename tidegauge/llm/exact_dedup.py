"""Exact deduplication by a tree-merge of digest runs, in DataFrame functions only.

Rows are dealt over 2**rounds leaf runs by their id, so a group that holds most rows is spread too. Each leaf keeps one
entry per digest: the best identifier and the number of rows. In each round the runs whose numbers differ in one binary
digit are merged, keeping again the best identifier; Spark sorts and merges the runs on the digest. After the last
round one run is left, dealt out by digest. Only entries move between rounds, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ascii_lower, col, texts
from tidegauge.session import cut_lineage


def digest_runs(rows: DataFrame, best, rounds: int) -> DataFrame:
    """digest..., keep_id, group_size from rows (sha, size, check, doc_id), merged in binomial rounds."""
    key = ["sha", "size", "check"]
    leaf: Column = F.pmod(F.xxhash64("doc_id"), F.lit(1 << rounds)).cast("int")
    runs = rows.groupBy(*key, leaf.alias("run")).agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    for _ in range(rounds):
        merged = [*key, F.shiftright("run", 1).alias("run")]
        runs = runs.groupBy(*merged).agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return runs.drop("run")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", rounds: int = 4) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when they are identical after lower-casing A-Z only; null counts as empty. Of a group the row with the smallest
    (or `keep="largest"`) id stays. Equality is decided on SHA-256, verified by the length in bytes and a second hash. Null ids
    lose to any other; a group of null ids alone keeps its rows, as do repeated rows with the id that stays.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = texts(df, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("t"))
    rows = rows.select("doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("size"), F.xxhash64("t").alias("check"))
    # Digests are written once: the tree and the way back to the rows both read them, and texts are read once.
    rows = cut_lineage(rows)
    key = ["sha", "size", "check"]
    groups = digest_runs(rows, best, rounds)
    return rows.join(groups, key).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `df` that stay, with all their columns. Rows that share an id stay or go together; null ids stay."""
    judged = exact_duplicates(df, id_col, text_col, keep).groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or("kept").alias("_kept"))
    return df.join(judged.filter(~F.col("_kept")).select("_gone").hint("merge"), col(id_col) == F.col("_gone"), "left_anti")
