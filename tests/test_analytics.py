"""Distribution, association, temporal and evaluation contracts that SQL twins do not show."""

import datetime as dt
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidegauge.operators import association as A
from tidegauge.operators import binning as B
from tidegauge.operators import distribution as G
from tidegauge.operators import evaluation as I
from tidegauge.operators import temporal as T
from tidegauge.plans import workflows as W


def test_under_and_overflow(frame):
    df = frame([(-0.1,), (0.0,), (1.0000000000000002,), (20.0,), (None,), (float("inf"),)], "a double")
    h = {r["bin"]: r["n"] for r in G.unit_histogram(df, ["a"]).collect()}
    assert len(h) == 37 and (h[-1], h[0], h[34], h[35]) == (1, 1, 1, 1)
    assert G.feature_summary(df, ["a"]).first()["excluded"] == 2
    r = G.range_histogram(df, ["a"]).orderBy("bin").collect()
    assert len(r) == 35 and sum(x["n"] for x in r) == 4 and r[0]["low"] == -0.1 and r[-1]["high"] == 20.0


def test_actual_range_histogram_equals_numpy(spark):
    values = np.random.default_rng(5).normal(3, 40, 4000)
    want, edges = np.histogram(values, 35)
    got = G.range_histogram(spark.createDataFrame([(float(v),) for v in values], "a double"), ["a"]).orderBy("bin").collect()
    assert [r["n"] for r in got] == want.tolist()
    np.testing.assert_allclose([r["low"] for r in got], edges[:-1])


def test_constant_out_of_range_feature_has_one_bin(spark):
    got = G.range_histogram(spark.createDataFrame([(5.0,)] * 3, "a double"), ["a"]).collect()
    assert [(r["bin"], r["low"], r["high"], r["n"]) for r in got] == [(0, 5.0, 5.0, 3)]


def test_feature_without_finite_values(frame):
    r = G.feature_summary(frame([(None,), (float("nan"),)], "a double"), ["a"]).first()
    assert (r["n"], r["excluded"], r["median"], r["sd"]) == (0, 2, None, None)


def test_correlation_is_null_when_undefined(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 1.0, None), (3.0, 1.0, 5.0)], "a double, flat double, few double")
    r = {(x["feature_a"], x["feature_b"]): (x["r"], x["n"]) for x in G.correlation_matrix(df, ["a", "flat", "few"]).collect()}
    assert len(r) == 9 and r["a", "flat"] == (None, 3) and r["few", "a"] == (None, 2) and r["a", "a"][0] == pytest.approx(1)


def test_stratified_sample_is_bounded_and_repeatable(spark):
    df = spark.range(2400).select("id", (F.col("id") % 4).cast("int").alias("c"))
    first = sorted(r["id"] for r in G.stratified_sample(df, "c", "id", 4).collect())
    assert len(first) == 1000 and first == sorted(r["id"] for r in G.stratified_sample(df.repartition(5), "c", "id", 4).collect())


def test_stratified_sample_ranks_few_rows_of_a_hot_class(spark):
    hot = spark.range(200_000).select("id", F.when(F.col("id") % 50 != 0, 1).when(F.col("id") % 100 == 0, 2).alias("_class"))
    df = hot.unionByName(spark.createDataFrame([(None, 1), (200_001, 3)], "id bigint, _class int"))
    got = G.stratified_sample(df, "_class", "id", 4, limit=12_000)
    by_class = {r["_class"]: r["count"] for r in got.groupBy("_class").count().collect()}
    assert by_class == {1: 3000, 2: 2000, None: 2000, 3: 1} and got.columns == ["id", "_class"]
    want = df.filter("_class = 1").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("42")).cast("binary")), "id").limit(3000)
    kept = {r["id"] for r in got.filter("_class = 1").collect()}
    assert kept == {r["id"] for r in want.collect()} and None in kept
    assert G.stratified_sample(df.limit(0), "_class", "id", 4).count() == 0


def test_joint_bins_sum_to_class_counts(spark):
    df = spark.range(500).select((F.rand(1)).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("d"), (F.col("id") % 3).cast("int").alias("c"))
    t = G.joint_bins(df, ["a", "b", "d"], "c").groupBy("feature_a", "feature_b", "class").agg(F.sum("n").alias("n")).collect()
    assert len(t) == 9 and {r["n"] for r in t} == {166, 167}


def test_eta_needs_two_classes(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "a double, c int")
    assert G.eta_squared(df, ["a"], "c").first()["eta_squared"] is None
    assert G.eta_squared(df, ["a"], "c", undefined_zero=True).first()["eta_squared"] == 0.0


def test_cumulative_share_of_nothing(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "code int, n int")
    assert {r["end_percent"] for r in G.cumulative_share(df).collect()} == {0.0}


def test_edges_need_two_distinct_values(frame):
    with pytest.raises(ValueError, match="two distinct"):
        B.fit_edges(frame([(1.0,)] * 9, "a double"), ["a"], 5)


def test_bins_beyond_the_fitted_ends(spark):
    df = spark.createDataFrame([(v,) for v in (-9.0, 0.0, 1.0, 1.5, 2.0, 99.0)], "a double")
    assert [r["a"] for r in B.assign_bins(df, {"a": [0.0, 1.0, 2.0]}).collect()] == [0, 0, 1, 1, 1, 1]


def test_pair_agreement_is_zero_without_common_cells(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1, "train"), (1.0, 0.0, 0, "test")], "a double, b double, y int, part string")
    r = B.pair_rate_deviation(df, {"a": [0.0, 0.5, 1.0], "b": [0.0, 0.5, 1.0]}, "y", "part").first()
    assert (r["train_deviation"], r["test_deviation"], r["agreement"]) == (0.0, 0.0, 0.0)


def test_autocorrelation_across_block_borders(spark, monkeypatch):
    monkeypatch.setattr(T, "LAG_BLOCK", 50)
    x = np.random.default_rng(2).normal(size=1000)
    df = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(x)], "obs bigint, v double")
    got = {r["lag"]: (r["r"], r["n_pairs"]) for r in T.autocorrelation(df, "obs", "v", (1, 4, 7)).collect()}
    for k in (1, 4, 7):
        assert got[k][0] == pytest.approx(np.corrcoef(x[k:], x[:-k])[0, 1]) and got[k][1] == 1000 - k


def test_short_series_has_no_autocorrelation(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "obs bigint, v double")
    assert {r["r"] for r in T.autocorrelation(df, "obs", "v", (1, 672)).collect()} == {None}


def test_binary_golden_vector(frame):
    df = frame([(0, 0, .1), (0, 1, .8), (1, 0, .2), (1, 1, .9)], "y int, yhat int, s double")
    r = I.binary_metrics(df, "y", "yhat", "s").first()
    assert r["roc_auc"] == pytest.approx(0.75) and r["average_precision"] == pytest.approx(0.8333333333)
    assert {r["accuracy"], r["precision"], r["recall"], r["f1"]} == {0.5}


def test_perfect_and_missing_classes(frame):
    rows = [(c, [1.0 if i == c else 0.0 for i in range(4)]) for c in range(4)]
    df = I.argmax_class(frame(rows, "y int, p array<double>"), "p", [0, 1, 2, 3])
    r = I.evaluate(df, "y", "yhat", "p", [0, 1, 2, 3]).first()
    assert r["accuracy"] == r["macro_f1"] == r["macro_roc_auc"] == r["macro_average_precision"] == 1 and r["brier_sum"] == 0
    assert r["log_loss"] == pytest.approx(0, abs=1e-12) and r["independent_test"] is False
    b = I.reliability(df, "y", "p", [0, 1, 2, 3]).collect()
    assert [(x["lower"], x["upper"], x["n"]) for x in b] == [(0.9, 1.0, 4)]
    part = I.evaluate(df.filter("y < 3"), "y", "yhat", "p", [0, 1, 2, 3]).first()
    assert part["macro_roc_auc"] is None and part["macro_average_precision"] is None


def test_auc_with_ties_equals_pair_counting(frame):
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 300), np.round(rng.uniform(0, 1, 300), 1)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    df = frame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    assert I.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(want)


def test_one_class_only_gives_no_auc(frame):
    assert I.roc_auc(frame([(1, 0.5), (1, 0.6)], "y int, s double"), "y", "s").first()["roc_auc"] is None


def test_argmax_takes_the_lowest_index(spark):
    assert I.argmax_class(spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>"), "p", [0, 1, 2]).first()["yhat"] == 0


def series(spark, n):
    start = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(42)
    rows = [(start + dt.timedelta(minutes=15 * i), int(i % 5 == 0), i % 4, *[float(v) for v in rng.normal(size=24)]) for i in range(n)]
    names = [f"f{i}" for i in range(24)]
    return spark.createDataFrame(rows, "ts timestamp, y int, c int, " + ", ".join(f"{f} double" for f in names)), names


def test_binary_signal_shapes(spark):
    df, names = series(spark, 60)
    r = W.binary_signal(df, names, "y", "ts")
    assert {x["part"]: x["n"] for x in r["parts"].collect()} == {"train": 48, "test": 12}
    assert r["pairs"].count() == 276 and r["features"].count() == 24
    assert [x["lag"] for x in r["autocorrelation"].collect()] == [1, 4, 96, 672]
    assert r["monthly_rate"].count() == 0
    mi = [x["mutual_information"] for x in r["features"].collect()]
    assert mi == sorted(mi, reverse=True) and not any(math.isnan(m) for m in mi)


def test_class_signal_shapes(spark):
    df, names = series(spark, 80)
    r = W.class_signal(df, names, "c", {0: "a", 1: "b", 2: "c", 3: "d"}, "ts", ["y"])
    assert r["distribution"].count() == 8 and r["class_features"].count() == 96 and r["pairs"].count() == 276
    assert r["autocorrelation"].count() == 16 and r["leakage"].first()["in_features"] is False


def test_dashboard_without_labels_or_reference(spark):
    df = spark.createDataFrame([(1, "0.5", "x"), (2, "0.7", ""), (3, "2", "0.1")], "obs int, a string, b string")
    d = W.dashboard(df, ["a", "b"], "obs")
    assert {r["feature"]: (r["excluded"], r["outside"]) for r in d["quality"].collect()} == {"a": (0, 1), "b": (2, 0)}
    assert "comparison" not in d and d["sample"].count() == 3 and d["warnings"].count() == 2


def test_dashboard_rejects_unknown_labels(spark):
    df = spark.createDataFrame([(1, 0.5, 4)], "obs int, a double, c int")
    with pytest.raises(ValueError, match="group_label"):
        W.dashboard(df, ["a"], "obs", "c", [0, 1, 2, 3])
