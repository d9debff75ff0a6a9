"""Profiling aggregates: overviews, summaries, audits and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.expr import col, cols, to_long
from tidegauge.functions.frames import attach, grid, zero_fill
from tidegauge.functions.ordering import count_descents, quantiles, same_cell
from tidegauge.operators.columns import try_timestamp
from tidegauge.operators.dedup import duplicate_count

LEVELS = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def moments(value: Column) -> list[Column]:
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
            F.min(value).alias("min"), F.max(value).alias("max")]


def summarize(long: DataFrame, keys, levels=LEVELS, value: str = "value", extra=()) -> DataFrame:
    """keys, n, mean, sd, min, max, one column per quantile level, plus `extra` aggregates.

    The moments are joined with quantiles that were found by narrowing, both already
    down to one row per key.
    """
    v = col(value)
    names = list(levels)
    pick = [F.col("q")[i].alias(n) for i, n in enumerate(names)]
    m = long.groupBy(*cols(keys)).agg(*moments(v), *extra)
    q = quantiles(long, keys, value, levels.values()).drop("n")
    out = same_cell(m, q, list(keys), "left") if keys else m.join(q)
    rest = [c for c in out.columns if c not in {*keys, "q", "n", "mean", "sd", "min", "max"}]
    return out.select(*cols(keys), "n", "mean", "sd", "min", "max", *pick, *cols(rest))


def overview(df: DataFrame) -> DataFrame:
    """column, dtype, n_rows, n_null in file column order."""
    cells = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("dtype"),
                      F.count("*").alias("n_rows"), F.count_if(col(n).isNull()).alias("n_null"))
             for i, (n, t) in enumerate(df.dtypes)]
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def quality_summary(df: DataFrame, timestamp: str, order: str) -> DataFrame:
    """One row: n_rows, n_columns, n_null, duplicate_rows, invalid and duplicate timestamps, sortedness."""
    parsed = df.select(*cols([order] if order != timestamp else []), try_timestamp(col(timestamp)).alias("_ts"),
                       *([try_timestamp(col(timestamp)).alias(order)] if order == timestamp else []))
    nulls = sum((F.count_if(col(n).isNull()) for n in df.columns), F.lit(0))
    base = df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), nulls.cast("bigint").alias("n_null"))
    stamps = parsed.groupBy("_ts").agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(F.when(F.col("_ts").isNull(), F.col("_n"))), F.lit(0)).cast("bigint").alias("invalid_timestamps"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_timestamps"))
    steps = count_descents(parsed, order, "_ts")
    out = attach(attach(attach(base, duplicate_count(df, out="duplicate_rows")), stamps), steps)
    in_order = (F.col("descents") == 0) & (F.col("invalid_timestamps") == 0)
    return out.withColumn("timestamps_sorted", in_order).drop("descents")


def value_counts(df: DataFrame, column: str, codes=None, group=()) -> DataFrame:
    """code, n, share; zero-filled to the codebook when one is given."""
    counts = df.groupBy(*cols(group), col(column).alias("code")).agg(F.count("*").alias("n"))
    if codes is not None and not group:
        counts = zero_fill(counts, grid(df.sparkSession, code=list(codes)), ["code"], ["n"])
    total = counts.groupBy(*cols(group)).agg(F.sum("n").alias("_t"))
    out = counts.join(total, list(group)) if group else attach(counts, total)
    return out.select(*cols(group), "code", "n", X.ratio0(F.col("n"), F.col("_t")).alias("share"))


def describe(df: DataFrame, features, levels=LEVELS) -> DataFrame:
    return summarize(to_long(df, features), ["feature"], levels)


def column_kinds(df: DataFrame) -> DataFrame:
    """column, dtype, n_null, n_distinct (nulls not counted).

    Values are counted per (column, value) first, so a hot value is one combined row.
    """
    text = df.select(*[col(n).cast("string").alias(n) for n in df.columns]).unpivot([], cols(df.columns), "column", "text")
    seen = text.groupBy("column", "text").agg(F.count("*").alias("_n"))
    null_rows = F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("_n"))), F.lit(0)).cast("bigint")
    out = seen.groupBy("column").agg(null_rows.alias("n_null"), F.count("text").alias("n_distinct"))
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return out.select("column", F.element_at(types, F.col("column")).alias("dtype"), "n_null", "n_distinct")


def blank_counts(df: DataFrame) -> DataFrame:
    """column, n_blank: null or empty after trimming."""
    cells = [F.struct(F.lit(n).alias("column"), F.count_if(X.blank(col(n))).alias("n_blank")) for n in df.columns]
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def iqr_fences(train: DataFrame, features, factor: float = 1.5) -> DataFrame:
    """feature, lower, upper from the training partition only."""
    q = quantiles(to_long(train, features), ["feature"], "value", [0.25, 0.75])
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return q.select("feature", (q1 - factor * (q3 - q1)).alias("lower"), (q3 + factor * (q3 - q1)).alias("upper"))


def iqr_flags(df: DataFrame, fences: DataFrame, features, group=()) -> DataFrame:
    """Rows outside the fitted fences; one fence row per feature, so it is broadcast."""
    long = to_long(df, features, group).join(F.broadcast(fences), "feature")
    flag = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return long.groupBy(*cols(group), "feature").agg(F.count_if(flag).alias("n_flagged"))


def audit_features(df: DataFrame, features, partition: str, train: str, tol: float = X.UNIT_TOLERANCE) -> DataFrame:
    """Per partition and feature: summary, nulls, infinities, out of [0,1] strictly and beyond the
    tolerance, and flags by the training partition's fences."""
    fences = iqr_fences(df.filter(col(partition) == F.lit(train)), features)
    v = F.col("value")
    long = to_long(df, features, [partition]).join(F.broadcast(fences), "feature")
    extra = [
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if(v.isNotNull() & ~F.isnan(v) & (F.abs(v) == F.lit(X.INF))).alias("n_infinite"),
        F.count_if(X.outside(v, tol=0.0)).alias("outside_unit"),
        F.count_if(X.outside(v, tol=tol)).alias("outside_unit_tolerant"),
        F.count_if((v < F.col("lower")) | (v > F.col("upper"))).alias("iqr_flags"),
    ]
    return summarize(long, [partition, "feature"], extra=extra)


def audit_partitions(df: DataFrame, features, target: str, partition: str) -> DataFrame:
    """Per partition: rows, columns, duplicate rows and duplicate feature vectors."""
    rows = df.groupBy(col(partition)).agg(F.count("*").alias("n_rows"))
    rows = rows.withColumn("n_columns", F.lit(len(df.columns) - 1))
    whole = duplicate_count(df, [*features, target], [partition], "duplicate_rows")
    views = duplicate_count(df, features, [partition], "duplicate_feature_rows")
    return rows.join(whole, partition).join(views, partition)


def audit_classes(df: DataFrame, target: str, partition: str) -> DataFrame:
    return value_counts(df, target, group=[partition])


def feature_statistics(df: DataFrame, features) -> DataFrame:
    """feature, n_missing, n_invalid, min, max (finite values of text or numeric columns)."""
    cells = []
    for f in features:
        kind, v = X.cell_kind(col(f)), X.finite(X.numeric_cell(col(f)))
        cells.append(F.struct(F.lit(f).alias("feature"), F.count_if(kind == "missing").alias("n_missing"),
                              F.count_if(kind != "valid").alias("n_invalid"), F.min(v).alias("min"), F.max(v).alias("max")))
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def time_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(col(column)).alias("first"), F.max(col(column)).alias("last"))


def target_correlations(df: DataFrame, targets, columns=None) -> DataFrame:
    """feature, target, r for every numeric column against the chosen targets, in one aggregate."""
    columns = columns or X.numeric_columns(df)
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(t).alias("target"),
                      X.pearson(col(c).cast("double"), col(t).cast("double")).alias("r")) for c in columns for t in targets]
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def display_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n pseudo-random rows, the same ones every time."""
    return df.orderBy(X.hash_order(col(key), seed), col(key)).limit(n)


def preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first rows by the file-order key."""
    return df.orderBy(col(order)).limit(n)


def split_boundary(df: DataFrame, partition: str, timestamp: str) -> DataFrame:
    return df.groupBy(col(partition)).agg(
        F.count("*").alias("n_rows"), F.min(col(timestamp)).alias("first"), F.max(col(timestamp)).alias("last"))
