"""Duplicate counting, set algebra between partitions, and append."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.expr import col, cols


def drop_duplicate_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """Identical rows once. With `order` the other columns decide and the earliest order value is kept."""
    if order is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != order]
    return df.groupBy(*cols(rest)).agg(F.min(col(order)).alias(order)).select(*cols(df.columns))


def duplicate_count(df: DataFrame, columns=None, group=(), out: str = "duplicates") -> DataFrame:
    """Rows beyond the first of each identical set."""
    columns = [c for c in (columns or df.columns) if c not in group]
    sets = df.groupBy(*cols(group), *cols(columns)).agg(F.count("*").alias("_n"))
    extra = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias(out)
    return sets.groupBy(*cols(group)).agg(extra) if group else sets.agg(extra)


def split_equation(full: DataFrame, train: DataFrame, test: DataFrame, columns, features) -> DataFrame:
    """One row: multiset equation train + test = full, exact-row overlap and feature-only overlap.

    Both groupings combine before they shuffle, so a row or a feature vector that
    repeats a great many times never lands in one task.
    """
    flags = [("full", full), ("train", train), ("test", test)]
    tagged = reduce(DataFrame.unionAll, [
        d.select(*cols(columns), *[F.lit(int(name == tag)).alias(f"_{tag}") for tag, _ in flags]) for name, d in flags])
    rows = tagged.groupBy(*cols(columns)).agg(*[F.sum(f"_{t}").alias(f"_{t}") for t, _ in flags])
    both = (F.col("_train") > 0) & (F.col("_test") > 0)
    views = rows.groupBy(*cols(features)).agg(
        F.count_if(F.col("_train") + F.col("_test") != F.col("_full")).alias("_unequal"),
        F.count_if(both).alias("_both"), F.sum("_train").alias("_train"), F.sum("_test").alias("_test"))
    return views.agg(
        (F.coalesce(F.sum("_unequal"), F.lit(0)) == 0).alias("reconstructs"),
        F.coalesce(F.sum("_unequal"), F.lit(0)).cast("bigint").alias("unequal_rows"),
        F.coalesce(F.sum("_both"), F.lit(0)).cast("bigint").alias("row_overlap"),
        F.count_if(both).alias("feature_overlap"))


def require_split(full: DataFrame, train: DataFrame, test: DataFrame, columns, features) -> dict:
    """Raise unless train + test rebuilds full and no feature vector is in both."""
    r = split_equation(full, train, test, columns, features).first().asDict()
    faults = [f"{r['unequal_rows']} rows whose counts in train and test do not add up to the full table"] * (not r["reconstructs"])
    faults += [f"{r['feature_overlap']} overlapping feature vectors in both train and test"] * bool(r["feature_overlap"])
    if faults:
        raise ValueError("; ".join(faults))
    return r


def row_overlap(a: DataFrame, b: DataFrame, columns) -> DataFrame:
    """Distinct rows found in both frames."""
    return a.select(*cols(columns)).intersect(b.select(*cols(columns)))


def duplicate_timestamps(df: DataFrame, column: str) -> DataFrame:
    return duplicate_count(df.select(col(column)), out="duplicate_timestamps")


def exclude_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose fingerprint is not in the known table."""
    return df.join(known.select(col(key)).distinct(), key, "left_anti")


def only_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(col(key)).distinct(), key, "left_semi")


def append(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
