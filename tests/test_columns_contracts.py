import datetime as dt

import pytest

from pyspark.sql import functions as F

from tidegauge.operators import columns as P
from tidegauge.operators import contracts as C
from tidegauge.operators import dedup as D
from tidegauge.operators import profile as E
from tidegauge.plans import workflows as W

INF, NAN = float("inf"), float("nan")


def bad(violations):
    return {(r["check"], r["column"]): r["n_bad"] for r in violations.collect() if r["n_bad"]}


def test_snake_names(spark):
    df = spark.createDataFrame([(1, 2)], [" Motor Temperature (C) ", "Return-Flag!"])
    assert P.normalize_names(df).columns == ["motor_temperature_c", "returnflag"]


def test_headers():
    assert P.check_headers([" a", "b "]) == {" a": "a", "b ": "b"}
    for names in (["a", " "], ["a", "a "], ["x" * 200]):
        with pytest.raises(ValueError):
            P.check_headers(names, max_length=128)
    with pytest.raises(ValueError):
        P.check_headers(["a"] * 3, max_columns=2)


def test_allow_and_deny(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a", "b", "leak", "y"])
    assert P.allow_list(df, ["b", "a"]).columns == ["b", "a"]
    assert P.deny_list(df, "y", None, ["leak"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match="'c'"):
        P.allow_list(df, ["a", "c"])
    with pytest.raises(ValueError, match="target"):
        P.features_and_target(df, ["a"], "z")


@pytest.mark.parametrize("mapping,message", [
    ({"zz": "a"}, "Not a known"), ({"f1": "nope"}, "do not exist"), ({"f2": "a"}, "conflicts"), ({"f1": "a", "f3": "a"}, "own source"), ({"f1": "y"}, "own source")])
def test_rename_conflicts(spark, mapping, message):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "f2", "y"])
    with pytest.raises(ValueError, match=message):
        P.rename_map(df, mapping, ["f1", "f2", "f3"], "y")


@pytest.mark.parametrize("text,want", [("1", 1.0), (" 0.5 ", 0.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("inf", INF), ("-Infinity", -INF),
                                       ("NaN", None), ("1d", None), ("1_0", None), ("", None), ("word", None), (None, None), ("+-1", None)])
def test_numeric_cells(spark, text, want):
    df = spark.createDataFrame([(text,)], "a string")
    assert P.coerce_numeric(df, ["a"]).first()["a"] == want


def test_infinite_to_null_keeps_integers(spark):
    df = spark.createDataFrame([(INF, 1), (NAN, 2), (-INF, 3), (2.0, 4)], "a double, b int")
    assert [tuple(r) for r in P.infinite_to_null(df).collect()] == [(None, 1), (None, 2), (None, 3), (2.0, 4)]


def test_strict_and_lenient_timestamps(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-01",)], "ts string")
    assert P.parse_and_sort(df, "ts").first()["ts"] == dt.datetime(2024, 1, 1)
    assert P.parse_and_sort(df, "other") is df
    broken = df.unionAll(spark.createDataFrame([("nope",), (None,)], "ts string"))
    with pytest.raises(ValueError, match="2 values of 'ts' cannot be read"):
        P.parse_and_sort(broken, "ts")
    with pytest.raises(Exception):
        P.parse_timestamp(broken, "ts").collect()
    with pytest.raises(ValueError, match="no column"):
        P.parse_timestamp(df, "other")


def test_range_filter_bounds(spark):
    df = spark.createDataFrame([(0.1, 0.2)], "a double, b double")
    for r in ((1.0, 0.0), (0.0, INF), (NAN, 1.0)):
        with pytest.raises(ValueError):
            P.filter_range(df, "a", "b", r, (0.0, 1.0))


@pytest.mark.parametrize("values,problem", [([0, 1, 1], None), ([0, 0], "target_class_absent"), ([0, 1, None], "target_null"), ([0, 1, 2], "target_unknown")])
def test_binary_target(spark, values, problem):
    found = bad(C.binary_target(spark.createDataFrame([(v,) for v in values], "y int"), "y"))
    assert ({k[0] for k in found} == {problem}) if problem else not found


BASE = [(0.1, 0.9, 0.0), (0.2, 0.8, 1.0), (1.0000000000000002, 0.0, 2.0), (0.4, 0.6, 3.0)]


@pytest.mark.parametrize("change,check", [
    (lambda d: d, None), (lambda d: d.drop("b"), "schema"), (lambda d: d.withColumn("extra", F.lit(1.0)), "schema"),
    (lambda d: d.withColumn("a", F.lit("word")), "numeric"), (lambda d: d.withColumn("a", F.lit(None).cast("double")), "finite"),
    (lambda d: d.withColumn("a", F.lit(INF)), "finite"), (lambda d: d.withColumn("a", F.lit(NAN)), "finite"), (lambda d: d.withColumn("a", F.lit(1.5)), "range"),
    (lambda d: d.withColumn("y", F.lit(1.5)), "label"), (lambda d: d.withColumn("y", F.lit(4.0)), "label"), (lambda d: d.limit(0), "non_empty")])
def test_strict_frame_matrix(spark, change, check):
    df = change(spark.createDataFrame(BASE, "a double, b double, y double"))
    violations = C.strict_frame(df, ["a", "b"], "y", [0, 1, 2, 3])
    found = {k[0] for k in bad(violations)}
    assert (check in found) if check else not found
    if check:
        with pytest.raises(ValueError, match=check):
            C.require(violations)


def test_timestamps(frame):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 2, 4, 3)]
    df = frame([(i, v) for i, v in enumerate([*t, None])], "i int, ts timestamp")
    assert bad(C.valid_timestamps(df, "ts", "i")) == {("timestamp_null", "ts"): 1, ("timestamp_duplicate", "ts"): 1, ("timestamp_unsorted", "ts"): 1}
    text = df.withColumn("ts", F.lit("x"))
    assert ("timestamp_type", "ts") in bad(C.valid_timestamps(text, "ts", "i"))
    with pytest.raises(ValueError, match="Missing required"):
        C.valid_timestamps(df, "nope", "i")


def test_cell_kinds_and_first_issues(spark):
    rows = [(i, c, "0.5") for i, c in enumerate(["", "NaN", "inf", "word", "1.5", "0.5", None], 1)]
    df = spark.createDataFrame(rows, "obs int, a string, b string")
    assert [r["kind"] for r in C.first_issues(df, ["b", "a"], "obs").collect()] == ["missing", "nonnumeric", "nonfinite", "nonnumeric", "out_of_range", "missing"]
    verdict = C.batch_verdict(df, ["b", "a"], "obs").first()
    assert (verdict["accepted"], verdict["first_obs"], verdict["first_feature"], verdict["first_kind"]) == (False, 1, "a", "missing")
    assert C.batch_verdict(df.limit(0), ["a"], "obs").first()["accepted"] is False


def test_probability_vectors(spark):
    good = [([0.2, 0.8], 0), ([1.0, 0.0], 1)]
    wrong = [([0.5, 0.6], 0), ([-0.1, 1.1], 0), ([NAN, 1.0], 0), ([1.0], 0), (None, 0), ([0.5, 0.5], 7), ([0.5, 0.5], None)]
    df = spark.createDataFrame(good + wrong, "p array<double>, y int")
    assert bad(C.probability_check(df, "p", [0, 1], "y")) == {("probabilities", "p"): 5, ("class_known", "y"): 2}
    assert bad(C.probability_check(df.limit(0), "p", [1, 0])) == {("class_order", "*"): 1}


def test_typed_record(spark):
    texts = ['{"a": 0.5, "b": 1}', '{"a": "0.5", "b": 1}', '{"a": 0.5}', '{"a": 0.5, "b": 1, "c": 2}', '{"a": null, "b": 1}', '{"a": true, "b": 1}', '{"a": 3, "b": 1}',
             "nope", None, "[]"]
    got = [r["problem"] for r in C.typed_record(spark.createDataFrame([(t,) for t in texts], "j string"), "j", {"a": (0, 1), "b": (0, 1)}).collect()]
    assert got == [None, "type", "fields", "fields", "type", "type", "range", "not_object", "not_object", "not_object"]


def test_duplicates_merge_nan_and_signed_zero(spark):
    df = spark.createDataFrame([(NAN, 1), (NAN, 1), (0.0, 2), (-0.0, 2), (None, 3), (None, 3), (5.0, 1)], "a double, b int")
    assert D.duplicate_count(df).first()["duplicates"] == 3
    assert D.drop_duplicate_rows(df).count() == 4
    text = spark.createDataFrame([("0.1",), ("0.10",)], "a string")
    assert D.duplicate_count(text).first()["duplicates"] == 0


def test_split_algebra(spark):
    full = spark.createDataFrame([(1.0, 0), (1.0, 0), (2.0, 1), (3.0, 1)], "a double, y int")
    test = full.filter("a = 3")
    train = full.filter("a <> 3")
    assert D.require_split(full, train, test, ["a", "y"], ["a"])["row_overlap"] == 0
    with pytest.raises(ValueError, match="do not add up to the full table"):
        D.require_split(full, train.dropDuplicates(), test, ["a", "y"], ["a"])
    shared = spark.createDataFrame([(1.0, 0), (1.0, 1)], "a double, y int")
    with pytest.raises(ValueError, match="overlapping"):
        D.require_split(shared, shared.filter("y = 0"), shared.filter("y = 1"), ["a", "y"], ["a"])


def test_quality_summary_counts_every_kind_of_bad_time(frame):
    df = frame([(1, "2024-01-01"), (2, "bad"), (3, None), (4, "2024-01-01"), (5, "2023-01-01")], "i int, ts string")
    r = E.quality_summary(df, "ts", "i").first()
    assert (r["n_rows"], r["invalid_timestamps"], r["duplicate_timestamps"], r["timestamps_sorted"], r["n_null"]) == (5, 2, 2, False, 1)


def test_clean_refuses_remaining_nulls(spark):
    df = spark.createDataFrame([(1.0, "2024-01-01"), (INF, "2024-01-02")], "`A b` double, timestamp string")
    with pytest.raises(ValueError, match="a_b"):
        W.clean(df)
    out, report = W.clean(df.filter("`A b` < 2").unionAll(df.filter("`A b` < 2")))
    assert out.columns == ["a_b", "timestamp"] and report.first()["duplicates_removed"] == 1
    with pytest.raises(ValueError, match="non_empty"):
        W.clean(df.limit(0))
