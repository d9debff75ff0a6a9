"""Monthly roll-ups and autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.expr import col
from tidegauge.functions.frames import grid

COMPLETE_MONTH_ROWS = 28 * 24 * 4
LAGS = (1, 4, 96, 672)
LAG_BLOCK = 1 << 16


def _monthly(df: DataFrame, timestamp: str, counted: Column, agg, min_rows: int) -> DataFrame:
    t = df.groupBy(F.last_day(col(timestamp)).alias("month")).agg(F.count(counted).alias("n"), *agg)
    return t.filter((F.col("n") >= min_rows) & (F.col("n") > 0))


def monthly_rate(df: DataFrame, timestamp: str, target: str, min_rows: int = COMPLETE_MONTH_ROWS) -> DataFrame:
    """month (its last day), n, rate for months with enough rows."""
    y = col(target).cast("double")
    return _monthly(df, timestamp, y, [F.avg(y).alias("rate")], min_rows)


def monthly_means(df: DataFrame, timestamp: str, features, counted: str, min_rows: int = COMPLETE_MONTH_ROWS) -> DataFrame:
    return _monthly(df, timestamp, col(counted), [F.avg(col(f).cast("double")).alias(f) for f in features], min_rows)


def monthly_class_shares(df: DataFrame, timestamp: str, label: str, names: dict, min_rows: int = COMPLETE_MONTH_ROWS) -> DataFrame:
    """month, n, one share column `<code>_<name>` per class."""
    known = col(label).isin(list(names))
    agg = [F.avg(F.when(known, (col(label) == c).cast("double"))).alias(f"{c}_{n}") for c, n in names.items()]
    return _monthly(df, timestamp, col(label), agg, min_rows)


def with_lags(df: DataFrame, obs: str, value: str, lags) -> DataFrame:
    """obs, x, lag_<k>: the value k rows earlier, for gap-free integer row numbers.

    Rows are cut into blocks by number. The last max(lags) rows of a block are
    copied into the next one, so every lag is found inside its block: one shuffle
    for all lags, and no block is larger than the others.
    """
    reach = max(lags)
    size = max(LAG_BLOCK, 16 * reach)
    block = F.floor(col(obs) / size)
    late = F.pmod(col(obs), F.lit(size)) >= size - reach
    rows = df.select(col(obs).alias("obs"), col(value).alias("x"), block.alias("_home"),
                     F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"))
    w = W.partitionBy("_block").orderBy("obs")
    rows = rows.select("*", *[F.lag("x", k).over(w).alias(f"lag_{k}") for k in lags])
    return rows.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def autocorrelation(df: DataFrame, obs: str, value: str, lags=LAGS) -> DataFrame:
    """lag, r, n_pairs; r is null for a constant or too short series."""
    series = with_lags(df.withColumn("_x", col(value).cast("double")), obs, "_x", lags)
    cells = [F.struct(F.lit(k).alias("lag"), X.pearson(F.col("x"), F.col(f"lag_{k}")).alias("r"),
                      F.count_if(F.col("x").isNotNull() & F.col(f"lag_{k}").isNotNull()).alias("n_pairs")) for k in lags]
    return series.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def class_autocorrelation(df: DataFrame, obs: str, label: str, codes, lags=LAGS) -> DataFrame:
    """class, lag, r of each class indicator. The label is lagged once for all classes."""
    series = with_lags(df, obs, label, lags)
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col("x"), F.col(f"lag_{k}").alias("z")) for k in lags]))
    counts = series.select(pairs).groupBy("lag", "x", "z").agg(F.count("*").cast("double").alias("n"))
    # A few class pairs per lag are left; indicator correlations follow from their counts.
    counts = counts.filter(F.col("x").isNotNull() & F.col("z").isNotNull())
    indicators = F.explode(F.array(*[F.lit(c) for c in codes])).alias("class")
    hit, late, n = F.col("x") == F.col("class"), F.col("z") == F.col("class"), F.col("n")
    t = counts.select("*", indicators).groupBy("class", "lag").agg(
        F.sum(n).alias("n"), F.sum(F.when(hit, n).otherwise(0.0)).alias("a"), F.sum(F.when(late, n).otherwise(0.0)).alias("b"),
        F.sum(F.when(hit & late, n).otherwise(0.0)).alias("ab"))
    a, b = F.col("a"), F.col("b")
    r = F.try_divide(n * F.col("ab") - a * b, F.sqrt(a * (n - a)) * F.sqrt(b * (n - b)))
    frame = grid(df.sparkSession, **{"class": list(codes), "lag": list(lags)})
    return frame.join(t.select("class", "lag", r.alias("r")), ["class", "lag"], "left")
