"""Distribution profiles, correlation, drift and class-summary tables.

Tables are long: one row per (group, feature[, bin]). `grp` is `all` or a class code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions import pairs
from tidegauge.functions.expr import col, cols, to_long
from tidegauge.functions.frames import attach, grid, with_groups, zero_fill
from tidegauge.operators.profile import QUARTILES, summarize

BINS = 35
REVIEW_DISTANCE = 0.25
REVIEW_ROWS = 30
SAMPLE_ROWS = 1000
JOINT_BINS = 20
#: Hash digits of a sampling cell: about a millionth of a class.
CELL_DIGITS = 5


def _grouped(df: DataFrame, features, label: str | None) -> tuple[DataFrame, list[str]]:
    if label is None:
        return df.select(F.lit("all").alias("grp"), *cols(features)), ["grp", "feature"]
    return with_groups(df.select(*cols(features), col(label)), label).select("grp", *cols(features)), ["grp", "feature"]


def _finite_long(df: DataFrame, features) -> DataFrame:
    return to_long(df, features, ["grp"]).withColumn("value", X.finite(F.col("value")))


def _groups(label, codes) -> list[str]:
    return ["all"] if label is None else ["all", *[str(c) for c in codes]]


def feature_summary(df: DataFrame, features, label: str | None = None, codes=()) -> DataFrame:
    """grp, feature, n, excluded, min, q1, median, q3, max, mean, sd over finite values.

    Groups without rows, and features without finite values, give 0 counts and nulls.
    """
    wide, keys = _grouped(df, features, label)
    excluded = F.count_if(F.col("value").isNull()).alias("excluded")
    s = summarize(_finite_long(wide, features), keys, QUARTILES, extra=[excluded])
    frame = grid(df.sparkSession, grp=_groups(label, codes), feature=list(features))
    out = frame.join(s, keys, "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n", "excluded")]
    return out.select(*keys, *zero, "min", "q1", "median", "q3", "max", "mean", "sd")


def unit_bin(v: Column, bins: int = BINS, tol: float = X.UNIT_TOLERANCE) -> Column:
    """-1 below the unit range, `bins` above it, else the fixed bin; the right edge is in the last bin."""
    inside = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(v * bins)))
    return F.when(v < -tol, F.lit(-1)).when(v > 1 + tol, F.lit(bins)).otherwise(inside).cast("int")


def unit_histogram(df: DataFrame, features, label: str | None = None, codes=(), bins: int = BINS) -> DataFrame:
    """grp, feature, bin, n with bins -1 (under) to `bins` (over), zero-filled."""
    wide, keys = _grouped(df, features, label)
    binned = _finite_long(wide, features).filter(F.col("value").isNotNull()).withColumn("bin", unit_bin(F.col("value"), bins))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    frame = grid(df.sparkSession, grp=_groups(label, codes), feature=list(features), bin=list(range(-1, bins + 1)))
    return zero_fill(counts, frame, [*keys, "bin"], ["n"])


def range_histogram(df: DataFrame, features, label: str | None = None, bins: int = BINS,
                    tol: float = X.UNIT_TOLERANCE) -> DataFrame:
    """grp, feature, bin, low, high, n over the actual range, only where a value leaves the unit range.

    A constant feature has one bin; the last bin is closed.
    """
    wide, keys = _grouped(df, features, label)
    long = _finite_long(wide, features).filter(F.col("value").isNotNull())
    v = F.col("value")
    spans = long.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")).filter(
        X.outside(F.col("_lo"), tol=tol) | X.outside(F.col("_hi"), tol=tol))
    lo, hi = F.col("_lo"), F.col("_hi")
    step = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(lo + i * step)

    first = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.lit(float(bins)), hi - lo), F.lit(0.0)) * (v - lo)))
    shifted = first - (v < edge(first)).cast("int") + ((v >= edge(first + 1)) & (first != bins - 1)).cast("int")
    index = F.when(lo == hi, F.lit(0)).otherwise(shifted).cast("int")
    # One span per (group, feature): the broadcast has a fixed size.
    counts = long.join(F.broadcast(spans), keys).withColumn("bin", index).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    last = F.when(lo == hi, F.lit(0)).otherwise(F.lit(bins - 1))
    frame = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), last)))
    out = frame.join(counts, [*keys, "bin"], "left")
    b = F.col("bin")
    high = F.when(lo == hi, hi).otherwise(edge(b + 1))
    return out.select(*keys, "bin", edge(b).alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def correlation_matrix(df: DataFrame, features, label: str | None = None, min_pairs: int = 3) -> DataFrame:
    """grp, feature_a, feature_b, r, n for the full matrix; r is null below min_pairs or for a constant.

    One scan finds each feature's mean, the second adds up the products of the distances from it, by class; `all` is the sum of the classes.
    """
    features = list(features)
    grp = F.lit("all") if label is None else col(label).cast("string")
    wide = df.select(grp.alias("grp"), *[X.finite(col(f).cast("double")).alias(f) for f in features])
    means = wide.agg(*[F.coalesce(F.avg(col(f)), F.lit(0.0)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    parts = pairs.pair_moments(wide.select("grp", *[(col(f) - F.lit(means[i])).alias(f) for i, f in enumerate(features)]), features, "grp")
    if label is not None:
        parts = with_groups(parts.withColumnRenamed("grp", "_class"), "_class")
    names = F.array(*[F.lit(f) for f in features])
    x, y = (F.element_at(names, F.col(i) + 1) for i in ("ia", "ib"))
    half = pairs.added(parts, "grp").select("grp", x.alias("x"), y.alias("y"), pairs.correlation(min_pairs).alias("r"), F.col("n").cast("bigint").alias("n"))
    x, y = F.col("x"), F.col("y")
    both = F.array_distinct(F.array(F.struct(x.alias("feature_a"), y.alias("feature_b")), F.struct(y.alias("feature_a"), x.alias("feature_b"))))
    return half.select("grp", F.inline(both), "r", "n")


def stratified_sample(df: DataFrame, label: str, key: str, n_classes: int, limit: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """At most max(1, limit // n_classes) rows of each class, the same ones every time. A null class is a class of its own.

    Rows are counted by class and leading hash digits first. Only cells that reach into the sample go on to the ranking, so no class
    is ranked whole at any limit. Rows that share a key share a cell: `key` should be unique or nearly so.
    """
    budget = max(1, limit // n_classes)
    rank_key = X.hash_order(col(key), seed)
    cell = F.coalesce(F.substring(rank_key, 1, CELL_DIGITS), F.lit(""))  # a null key comes first, as in the ranking
    cells = df.groupBy(col(label).alias("_sampled"), cell.alias("_cell")).agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(W.partitionBy("_sampled").orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow))
    reached = cells.withColumn("_before", so_far - F.col("_n")).filter(F.col("_before") < budget)
    last = reached.groupBy("_sampled").agg(F.max("_cell").alias("_last_cell"))
    rows = df.join(last, col(label).eqNullSafe(F.col("_sampled"))).filter(cell <= F.col("_last_cell")).drop("_sampled", "_last_cell")
    w = W.partitionBy(col(label)).orderBy(rank_key, col(key))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= budget).drop("_r")


def joint_bins(df: DataFrame, features, label: str, bins: int = JOINT_BINS) -> DataFrame:
    """feature_a, feature_b, class, i, j, n for occupied cells of every feature pair."""
    cell = [F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(col(f) * bins))).cast("int").alias(f) for f in features]
    counts = pairs.pair_counts(df.select(col(label).alias("class"), *cell), features, "class", bins)
    return counts.select("feature_a", "feature_b", "class", F.col("a").alias("i"), F.col("b").alias("j"), "n")


def joint_marks(table: DataFrame, x: str, y: str, x_range, y_range, bins: int = JOINT_BINS) -> DataFrame:
    """class, x, y, n: bin centres of one feature pair, axes swapped for a reversed pair, inside the ranges."""
    for low, high in (x_range, y_range):
        if not (abs(low) < X.INF and abs(high) < X.INF and low < high):
            raise ValueError("Ranges must be finite, with minimum smaller than maximum")
    fa, fb = F.col("feature_a"), F.col("feature_b")
    chosen = table.filter(((fa == x) & (fb == y)) | ((fa == y) & (fb == x)))
    across, up = (F.col("i") + 0.5) / bins, (F.col("j") + 0.5) / bins
    marks = chosen.select("class", F.when(fa == x, across).otherwise(up).alias("x"),
                          F.when(fa == x, up).otherwise(across).alias("y"), "n")
    return marks.filter(F.col("x").between(*x_range) & F.col("y").between(*y_range))


def class_moments(long: DataFrame, keys, label: str) -> DataFrame:
    """n, mean and summed squared deviation per key and class, the basis of every variance split."""
    v = F.col("value")
    usable = long.filter(v.isNotNull() & col(label).isNotNull())
    return usable.groupBy(*cols(keys), col(label).alias("class")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("ss"))


def variance_split(parts: DataFrame, keys) -> DataFrame:
    """keys, between, total, classes from class moments: no second pass over the rows."""
    t = parts.groupBy(*cols(keys)).agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"),
        F.collect_list(F.struct("n", "mean", "ss")).alias("_p"), F.count("*").alias("classes"))
    m = F.col("_m")
    between = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["n"] * (p["mean"] - m) * (p["mean"] - m))
    within = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["ss"])
    return t.select(*cols(keys), between.alias("between"), (between + within).alias("total"), "classes")


def eta_squared(df: DataFrame, features, label: str, undefined_zero: bool = False) -> DataFrame:
    """feature, eta_squared clamped to [0,1]; undefined (one class or no variance) is null, or 0 on request."""
    long = to_long(df, features, [label]).withColumn("value", X.finite(F.col("value")))
    s = variance_split(class_moments(long, ["feature"], label), ["feature"])
    eta = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("between"), F.col("total"))))
    eta = F.when((F.col("total") > 0) & (F.col("classes") >= 2), eta)
    out = grid(df.sparkSession, feature=list(features)).join(s, "feature", "left")
    return out.select("feature", (F.coalesce(eta, F.lit(0.0)) if undefined_zero else eta).alias("eta_squared"))


def cell_quality(summary: DataFrame, histogram: DataFrame, bins: int = BINS) -> DataFrame:
    """feature, excluded, outside from the `all` rows of the summary and histogram tables."""
    out = histogram.filter((F.col("grp") == "all") & F.col("bin").isin(-1, bins)).groupBy("feature").agg(F.sum("n").alias("outside"))
    return summary.filter(F.col("grp") == "all").select("feature", "excluded").join(out, "feature")


def bin_shares(histogram: DataFrame) -> DataFrame:
    """feature, bin, share of the `all` rows; 0 for an empty source."""
    h = histogram.filter(F.col("grp") == "all")
    return h.select("feature", "bin", X.ratio0(F.col("n"), F.sum("n").over(W.partitionBy("feature"))).alias("share"))


def compare_shares(train: DataFrame, observed: DataFrame) -> DataFrame:
    """feature, bin, train_share, observed_share of two histograms with the same bins."""
    a = bin_shares(train).withColumnRenamed("share", "train_share")
    b = bin_shares(observed).withColumnRenamed("share", "observed_share")
    return a.join(b, ["feature", "bin"])


def drift(df: DataFrame, features, train_summary: DataFrame, train_histogram: DataFrame, review_rows: int = REVIEW_ROWS,
          review_distance: float = REVIEW_DISTANCE, bins: int = BINS, tol: float = X.UNIT_TOLERANCE) -> DataFrame:
    """Observed rows against a training snapshot, one row per feature.

    Ranges and medians of both, rows outside the training range, total variation
    over the fixed bins with under and over, and the shape-review flag.
    """
    seen = feature_summary(df, features).select("feature", F.col("n").alias("finite_rows"), F.col("min").alias("observed_min"),
                                                F.col("max").alias("observed_max"), F.col("median").alias("observed_median"))
    base = train_summary.filter(F.col("grp") == "all").select(
        "feature", F.col("min").alias("training_min"), F.col("max").alias("training_max"), F.col("median").alias("training_median"))
    base = base.filter(F.col("feature").isin(list(features)))
    v = X.finite(F.col("value"))
    outside = to_long(df, features).join(F.broadcast(base), "feature").groupBy("feature").agg(F.count_if(
        (v < F.col("training_min") - tol) | (v > F.col("training_max") + tol)).alias("outside_training_range"))
    shares = compare_shares(train_histogram, unit_histogram(df, features, bins=bins))
    distance = shares.groupBy("feature").agg((F.sum(F.abs(F.col("train_share") - F.col("observed_share"))) / 2).alias("_tv"))
    out = base.join(seen, "feature").join(outside, "feature", "left").join(distance, "feature", "left")
    tv = F.when(F.col("finite_rows") > 0, F.col("_tv"))
    review = F.coalesce((F.col("finite_rows") >= review_rows) & (tv > review_distance), F.lit(False))
    return out.select("feature", "training_min", "training_max", "training_median", "observed_min", "observed_max",
                      "observed_median", F.coalesce("outside_training_range", F.lit(0)).cast("bigint").alias("outside_training_range"),
                      "finite_rows", tv.alias("total_variation"), review.alias("shape_review"))


def class_share(df: DataFrame, label: str, codes) -> DataFrame:
    """code, n, percent; zero-filled."""
    from tidegauge.operators.profile import value_counts

    return value_counts(df, label, codes).select("code", "n", (F.col("share") * 100).alias("percent"))


def dominant_abnormal(counts: DataFrame, names: dict, normal) -> DataFrame:
    """One row: the abnormal classes that share the largest positive count, and the single one if unique."""
    pairs = [F.lit(x) for p in names.items() for x in p]
    rows = counts.filter((F.col("code") != F.lit(normal)) & (F.col("n") > 0))
    best = rows.groupBy("n").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    top = best.agg(F.max_by("codes", "n").alias("codes"))
    codes = F.coalesce("codes", F.array().cast("array<int>"))
    named = F.transform(codes, lambda c: F.element_at(F.create_map(*pairs), c))
    return top.select(F.when(F.size(codes) == 1, named[0]).alias("dominant"), F.array_join(named, ",").alias("tied"),
                      F.size(codes).alias("n_tied"))


def mean_confidence(df: DataFrame, confidence: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.avg(col(confidence)).alias("mean_confidence"))


def first_rows(df: DataFrame, order: str, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first n rows by order, each with the total row count and whether rows were left out."""
    total = df.agg(F.count("*").alias("total_rows"))
    out = attach(df.orderBy(col(order)).limit(n), total)
    return out.withColumn("truncated", F.col("total_rows") > n)


def quality_warnings(quality: DataFrame, comparison: DataFrame | None = None) -> DataFrame:
    """feature, warning: one text row per raised counter."""
    f = F.col("feature")
    found = [
        (F.col("excluded") > 0, F.format_string("%s: %d cells unavailable for charts.", f, F.col("excluded"))),
        (F.col("outside") > 0, F.format_string("%s: %d values outside [0,1].", f, F.col("outside"))),
    ]
    table = quality
    if comparison is not None:
        table = table.join(comparison.select("feature", "outside_training_range", "shape_review"), "feature", "left")
        found += [
            (F.col("outside_training_range") > 0, F.format_string("%s: %d outside the training range.", f, F.col("outside_training_range"))),
            (F.col("shape_review"), F.format_string("%s: distribution shape differs.", f)),
        ]
    texts = F.array(*[F.when(test, text) for test, text in found])
    return table.select(f, F.explode(F.filter(texts, lambda t: t.isNotNull())).alias("warning"))


def cumulative_share(counts: DataFrame) -> DataFrame:
    """code, n, start and end percent in code order; a class table is one row per code."""
    w = W.partitionBy(F.lit(0))
    run = F.sum("n").over(w.orderBy("code").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(w)
    return counts.select("code", "n", (X.ratio0(run - F.col("n"), total) * 100).alias("start_percent"),
                         (X.ratio0(run, total) * 100).alias("end_percent"))
