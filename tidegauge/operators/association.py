"""Association screens between features and a binary or class target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.expr import col, to_long
from tidegauge.operators.binning import _long_bins, fit_edges
from tidegauge.operators.distribution import class_moments, variance_split
from tidegauge.operators.evaluation import auc_from_tally, score_tally
from tidegauge.operators.profile import summarize

PAIR_LEVELS = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def class_summary(df: DataFrame, features, label: str) -> DataFrame:
    """feature, class, n, mean, median, sd, q05, q25, q75, q95."""
    long = to_long(df, features, [label]).filter(col(label).isNotNull())
    s = summarize(long, ["feature", label], PAIR_LEVELS).withColumnRenamed(label, "class")
    return s.select("feature", "class", "n", "mean", "median", "sd", "q05", "q25", "q75", "q95")


def two_group_summary(df: DataFrame, features, target: str) -> DataFrame:
    """feature, then n, mean, median, sd and quantiles of target 0 and 1 side by side, and mean_difference."""
    s = class_summary(df, features, target)
    names = ("n", "mean", "median", "sd", "q05", "q25", "q75", "q95")
    sides = [F.max(F.when(F.col("class") == g, F.col(n))).alias(f"{n}_{g}") for n in names for g in (0, 1)]
    out = s.groupBy("feature").agg(*sides)
    return out.withColumn("mean_difference", F.col("mean_1") - F.col("mean_0"))


def cohens_d(groups: DataFrame) -> DataFrame:
    """feature, cohens_d from a two-group table: pooled sample variance, 0 when that is 0."""
    n0, n1 = F.col("n_0"), F.col("n_1")
    pooled = X.ratio((n0 - 1) * F.col("sd_0") * F.col("sd_0") + (n1 - 1) * F.col("sd_1") * F.col("sd_1"), n0 + n1 - 2)
    d = F.when(pooled == 0, F.lit(0.0)).otherwise((F.col("mean_1") - F.col("mean_0")) / F.sqrt(pooled))
    return groups.select("feature", d.alias("cohens_d"))


def point_biserial(df: DataFrame, features, target: str) -> DataFrame:
    y = col(target).cast("double")
    cells = [F.struct(F.lit(f).alias("feature"), X.pearson(col(f).cast("double"), y).alias("r")) for f in features]
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def _either_way(auc: Column) -> Column:
    return F.greatest(auc, 1 - auc)


def univariate_auc(df: DataFrame, features, target: str) -> DataFrame:
    """feature, auc of a binary target, direction free."""
    tally = score_tally(to_long(df, features, [target]), ["feature"], "value", {"auc": col(target) == 1})
    return auc_from_tally(tally, ["feature"], ["auc"]).select("feature", _either_way(F.col("auc")).alias("auc"))


def one_vs_rest_auc(df: DataFrame, features, label: str, codes) -> DataFrame:
    """feature, class, auc: all classes share one tally per distinct value."""
    names = {f"c{i}": col(label) == c for i, c in enumerate(codes)}
    tally = score_tally(to_long(df, features, [label]), ["feature"], "value", names)
    wide = auc_from_tally(tally, ["feature"], list(names))
    cells = [F.struct(F.lit(c).alias("class"), _either_way(F.col(n)).alias("auc")) for n, c in zip(names, codes)]
    return wide.select("feature", F.inline(F.array(*cells)))


def auc_summary(per_class: DataFrame) -> DataFrame:
    """feature, macro_auc, best_auc, best_class (the first one on a tie)."""
    best = F.min(F.struct((-F.col("auc")).alias("a"), F.col("class").alias("c")))
    t = per_class.groupBy("feature").agg(F.avg("auc").alias("macro_auc"), best.alias("b"))
    return t.select("feature", "macro_auc", (-F.col("b.a")).alias("best_auc"), F.col("b.c").alias("best_class"))


def mutual_information(df: DataFrame, features, label: str, bins: int = 10, edges=None) -> DataFrame:
    """feature, mutual_information in nats: plug-in estimate over quantile bins.

    Counts of (feature, bin, class) are all that leaves the scan.
    """
    edges = edges or fit_edges(df, features, bins)
    counts = _long_bins(df, edges, [label]).groupBy("feature", "bin", label).agg(F.count("*").cast("double").alias("n"))

    def over(*keys: str) -> Column:
        return F.sum("n").over(W.partitionBy("feature", *keys))

    cells = counts.select("feature", "n", over().alias("t"), over("bin").alias("nb"), over(label).alias("nc"))
    term = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("nc")))
    return cells.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_information"))


def rank_features(table: DataFrame, scores, features, n: int | None = None) -> DataFrame:
    """Rows by descending score(s), ties in the given feature order; optionally the first n."""
    out = table.orderBy(*[col(s).desc() for s in ([scores] if isinstance(scores, str) else scores)], X.feature_positions(features))
    return out if n is None else out.limit(n)


def leakage_summary(df: DataFrame, excluded, features, label: str) -> DataFrame:
    """column, in_features, dtype, eta_squared, class_mean_min, class_mean_max; numbers for numeric columns only."""
    types = dict(df.dtypes)
    numeric = [c for c in excluded if X.is_numeric_type(types[c]) and c != label]
    cells = [F.struct(F.lit(c).alias("column"), F.lit(c in features).alias("in_features"), F.lit(types[c]).alias("dtype")) for c in excluded]
    frame = df.sparkSession.range(1).select(F.inline(F.array(*cells)))
    parts = class_moments(to_long(df, numeric, [label]), ["feature"], label)
    means = parts.groupBy("feature").agg(F.min("mean").alias("class_mean_min"), F.max("mean").alias("class_mean_max"))
    s = variance_split(parts, ["feature"])
    eta = F.coalesce(F.try_divide(F.col("between"), F.col("total")), F.lit(0.0))
    known = s.select("feature", eta.alias("eta_squared")).join(means, "feature").withColumnRenamed("feature", "column")
    return frame.join(known, "column", "left")
