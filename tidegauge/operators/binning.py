"""Quantile bins fitted on the earlier part, target rates per bin, and feature-pair grids.

Fitted edges are a few numbers per feature. They are read once and become literals,
so assigning a bin is plain generated code: no join and no reshaping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.expr import col, cols, to_long
from tidegauge.functions.frames import attach, grid
from tidegauge.functions.ordering import quantiles
from tidegauge.functions.pairs import pair_counts

MIN_CELL = 100


def quantile_edges(train: DataFrame, features, bins: int) -> DataFrame:
    """feature, edges: distinct linear quantiles at 0, 1/bins, ..., 1."""
    q = quantiles(to_long(train, features), ["feature"], "value", [i / bins for i in range(bins + 1)])
    return q.select("feature", F.array_distinct("q").alias("edges"))


def fit_edges(train: DataFrame, features, bins: int) -> dict[str, list[float]]:
    """Edges per feature on the driver; a feature without two distinct values is an error."""
    found = {r["feature"]: list(r["edges"]) for r in quantile_edges(train, features, bins).collect()}
    for f in features:
        if len(found.get(f, ())) < 3:
            raise ValueError(f"Feature {f!r} needs at least two distinct values for quantile binning.")
    return {f: found[f] for f in features}


def bin_of(value: Column, edges) -> Column:
    """Number of interior edges <= value; values beyond the ends fall into the end bins."""
    return sum(((value >= F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))


def assign_bins(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Feature columns replaced by their int bin numbers."""
    return df.withColumns({f: bin_of(col(f).cast("double"), e).cast("int") for f, e in edges.items()})


def _bin_frame(spark: SparkSession, edges) -> DataFrame:
    cells = [F.struct(F.lit(f).alias("feature"), F.lit(len(e) - 1).alias("_k")) for f, e in edges.items()]
    frame = spark.range(1).select(F.inline(F.array(*cells)))
    return frame.select("feature", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("bin"))


def _long_bins(df: DataFrame, edges, keep) -> DataFrame:
    binned = assign_bins(df.select(*cols(edges), *cols(keep)), edges)
    return binned.unpivot(cols(keep), cols(edges), "feature", "bin")


def binned_rates(df: DataFrame, edges, target: str, partition: str) -> DataFrame:
    """feature, bin, train_count, train_rate, test_count, test_rate; empty bins are 0."""
    long = _long_bins(df, edges, [target, partition])
    agg = []
    for p in ("train", "test"):
        y = F.when(col(partition) == p, col(target).cast("double"))
        agg += [F.count(y).alias(f"{p}_count"), F.avg(y).alias(f"{p}_rate")]
    counts = long.groupBy("feature", "bin").agg(*agg)
    out = _bin_frame(df.sparkSession, edges).join(counts, ["feature", "bin"], "left")
    return out.fillna(0, [c for c in out.columns if c not in ("feature", "bin")])


def rate_spread(rates: DataFrame) -> DataFrame:
    """feature, train_spread, test_spread: highest minus lowest binned rate."""
    return rates.groupBy("feature").agg(*[(F.max(f"{p}_rate") - F.min(f"{p}_rate")).alias(f"{p}_spread") for p in ("train", "test")])


def class_rates_by_bin(df: DataFrame, edges, label: str, codes, partition: str) -> DataFrame:
    """feature, bin, <part>_count and <part>_rate_<code> for both parts; empty bins are 0."""
    long = _long_bins(df, edges, [label, partition])
    agg = []
    for p in ("train", "test"):
        here = col(partition) == p
        agg.append(F.count_if(here & col(label).isin(list(codes))).alias(f"{p}_count"))
        agg += [F.count_if(here & (col(label) == c)).alias(f"_{p}_{c}") for c in codes]
    counts = long.groupBy("feature", "bin").agg(*agg)
    out = _bin_frame(df.sparkSession, edges).join(counts, ["feature", "bin"], "left").fillna(0)
    rates = []
    for p in ("train", "test"):
        rates.append(F.col(f"{p}_count"))
        rates += [X.ratio0(F.col(f"_{p}_{c}"), F.col(f"{p}_count")).alias(f"{p}_rate_{c}") for c in codes]
    return out.select("feature", "bin", *rates)


def class_rate_ratio(rates: DataFrame, distribution: DataFrame, codes) -> DataFrame:
    """feature, bin, <part>_ratio_<code>: the bin's class rate over the part's class rate."""
    base = distribution.agg(*[F.max(F.when((F.col("part") == p) & (F.col("class") == c), F.col("share"))).alias(f"_{p}_{c}")
                              for p in ("train", "test") for c in codes])
    out = attach(rates, base)
    return out.select("feature", "bin", *[X.ratio(F.col(f"{p}_rate_{c}"), F.col(f"_{p}_{c}")).alias(f"{p}_ratio_{c}")
                                          for p in ("train", "test") for c in codes])


def class_distribution(df: DataFrame, label: str, codes, partition: str, names: dict | None = None) -> DataFrame:
    """part, class, n, share (and class_name); zero-filled for both parts."""
    counts = df.groupBy(col(partition).alias("part"), col(label).alias("class")).agg(F.count("*").alias("n"))
    total = df.groupBy(col(partition).alias("part")).agg(F.count("*").alias("_t"))
    frame = grid(df.sparkSession, **{"part": ["train", "test"], "class": list(codes)})
    out = frame.join(counts, ["part", "class"], "left").join(total, "part", "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    named = []
    if names:
        named = [F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("class")).alias("class_name")]
    return out.select("part", "class", *named, n.alias("n"), X.ratio0(n, F.col("_t")).alias("share"))


def _pair_cells(df: DataFrame, edges, group: Column, measure: Column | None = None) -> DataFrame:
    """feature_a, feature_b, a, b, grp, n, total of every occupied cell; rows with a null in a feature, or a null group, take no part."""
    binned = assign_bins(df.select(group.alias("_grp"), *([measure.alias("_y")] if measure is not None else []), *cols(edges)), edges).filter("_grp IS NOT NULL")
    found = pair_counts(binned, list(edges), "_grp", max(map(len, edges.values())), "_y" if measure is not None else None)
    return found.withColumnRenamed("_grp", "grp")


def pair_rate_deviation(df: DataFrame, edges, target: str, partition: str, min_cell: int = MIN_CELL) -> DataFrame:
    """feature_a, feature_b, train_deviation, test_deviation, agreement.

    Largest distance of a cell's target rate from the part's base rate, over cells
    with at least min_cell rows, and the train/test correlation of the cell rates
    (0 with fewer than 2 common cells or a constant side).
    """
    y = col(target).cast("double")
    parts = {p: F.when(col(partition) == p, y) for p in ("train", "test")}
    counted = _pair_cells(df, edges, F.when(col(partition).isin("train", "test"), col(partition)), y)
    of = lambda p, name: F.sum(F.when(F.col("grp") == p, F.col(name)))
    cells = counted.groupBy("feature_a", "feature_b", "a", "b").agg(
        *[e for p in parts for e in (F.coalesce(of(p, "n"), F.lit(0)).alias(f"{p}_n"), F.try_divide(of(p, "total"), of(p, "n")).alias(f"{p}_rate"))])
    base = df.agg(*[F.avg(v).alias(f"{p}_base") for p, v in parts.items()])
    cells = attach(cells, base)

    def deviation(p: str) -> Column:
        d = F.when(F.col(f"{p}_n") >= min_cell, F.abs(F.col(f"{p}_rate") - F.col(f"{p}_base")))
        return F.coalesce(F.max(d), F.lit(0.0)).alias(f"{p}_deviation")

    common = (F.col("train_n") >= min_cell) & (F.col("test_n") >= min_cell)
    agreement = X.pearson(F.when(common, F.col("train_rate")), F.when(common, F.col("test_rate")))
    return cells.groupBy("feature_a", "feature_b").agg(
        deviation("train"), deviation("test"), F.coalesce(agreement, F.lit(0.0)).alias("agreement"))


def pair_class_pattern(df: DataFrame, edges, label: str, codes, partition: str, min_cell: int = MIN_CELL) -> DataFrame:
    """feature_a, feature_b, train_deviation, test_deviation, agreement for a class label.

    Deviation is the largest total variation between a cell's class shares and the
    part's class shares; agreement correlates the share residuals of all classes over
    the cells that are large enough in both parts.
    """
    codes = list(codes)
    # One number for part and class; labels without a code count in the totals only.
    place = sum((F.when(col(label) == c, i + 1).otherwise(0) for i, c in enumerate(codes)), F.lit(0))
    step = len(codes) + 1
    grp = F.when(col(partition) == "train", F.coalesce(place, F.lit(0))).when(col(partition) == "test", F.coalesce(place, F.lit(0)) + step)
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    counts = [n(F.col("grp") == k * step + i + 1).alias(f"{p}_{c}") for k, p in enumerate(("train", "test")) for i, c in enumerate(codes)]
    totals = [n(F.col("grp").between(k * step, k * step + step - 1)).alias(f"{p}_n") for k, p in enumerate(("train", "test"))]
    cells = _pair_cells(df, edges, grp.cast("int")).groupBy("feature_a", "feature_b", "a", "b").agg(*totals, *counts)
    prior = df.agg(*[F.avg(F.when(col(partition) == p, (col(label) == c).cast("double"))).alias(f"{p}_prior_{c}")
                     for p in ("train", "test") for c in codes])
    cells = attach(cells, prior)

    def residual(p: str, c) -> Column:
        return X.ratio0(F.col(f"{p}_{c}"), F.col(f"{p}_n")) - F.col(f"{p}_prior_{c}")

    def variation(p: str) -> Column:
        return F.when(F.col(f"{p}_n") >= min_cell, sum((F.abs(residual(p, c)) for c in codes), F.lit(0.0)) / 2)

    common = (F.col("train_n") >= min_cell) & (F.col("test_n") >= min_cell)
    pairs = F.array(*[F.struct(residual("train", c).alias("x"), residual("test", c).alias("y")) for c in codes])
    rows = cells.select("feature_a", "feature_b", variation("train").alias("tv_train"), variation("test").alias("tv_test"),
                        common.alias("common"), F.posexplode(pairs).alias("at", "r"))
    x, y = F.when(F.col("common"), F.col("r.x")), F.when(F.col("common"), F.col("r.y"))
    enough = F.count_if(F.col("common") & (F.col("at") == 0)) >= 2
    return rows.groupBy("feature_a", "feature_b").agg(
        F.coalesce(F.max("tv_train"), F.lit(0.0)).alias("train_deviation"),
        F.coalesce(F.max("tv_test"), F.lit(0.0)).alias("test_deviation"),
        F.coalesce(F.when(enough, X.pearson(x, y)), F.lit(0.0)).alias("agreement"))
