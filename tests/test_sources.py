"""Files, strict CSV, sinks, snapshots and saved models."""

import json
import os

import pytest

from pyspark.sql import functions as F

from tidegauge.operators import distribution as G
from tidegauge.operators import modeling as M
from tidegauge.plans import workflows as W
from tidegauge.sources import files as A
from tidegauge.sources import sinks as B
from tidegauge.streaming.landing import land

NAMES = {0: "Normal", 1: "Motor", 2: "Inverter", 3: "Battery"}


def write(folder, name, content):
    path = os.path.join(str(folder), name)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


def test_list_and_dispatch(spark, tmp_path):
    for n in ("b.csv", "a.json", "c.txt"):
        write(tmp_path, n, "x\n1\n")
    assert [r["name"] for r in A.list_files(spark, str(tmp_path)).collect()] == ["a.json", "b.csv"]
    with pytest.raises(ValueError, match="Unsupported"):
        A.load_dataset(spark, str(tmp_path / "c.txt"))
    write(tmp_path, "rows.json", json.dumps([{"a": 1}, {"a": 2}]))
    assert A.load_dataset(spark, str(tmp_path / "rows.json")).count() == 2


def test_title_row(spark, tmp_path):
    titled = write(tmp_path, "t.csv", "﻿My sensors\n\n a,b,when\n1,2.5,2024-01-01\n3,,2024-01-02\n")
    plain = write(tmp_path, "p.csv", "a,b\n1,2\n")
    short = write(tmp_path, "s.csv", "a,b\n")
    assert A.has_title_row(spark, titled) and not A.has_title_row(spark, plain) and not A.has_title_row(spark, short)
    df = A.load_dataset(spark, titled)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "when": "timestamp"}
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, 2.5), (3, None)]


def test_titled_csv_of_several_files(spark, tmp_path):
    (tmp_path / "d.csv").mkdir()
    write(tmp_path / "d.csv", "1.csv", "Sensors\r\na,b\r\n1,2\r\n3,4\r\n")
    write(tmp_path / "d.csv", "2.csv", "\n\nSensors, north\n\na,b\n5,6\nSensors,7\n")
    write(tmp_path / "d.csv", "3.csv", "Sensors\n")
    got = A._titled_csv(spark, str(tmp_path / "d.csv"))
    assert sorted(tuple(r) for r in got.collect()) == [("1", 2), ("3", 4), ("5", 6), ("Sensors", 7)]
    write(tmp_path / "d.csv", "4.csv", "\n" * A.HEAD_LINES + "Sensors\na,b\n8,9\n")
    with pytest.raises(Exception, match="no header among the first"):
        A._titled_csv(spark, str(tmp_path / "d.csv")).collect()


def test_titled_csv_with_two_headers_is_rejected(spark, tmp_path):
    (tmp_path / "d.csv").mkdir()
    write(tmp_path / "d.csv", "1.csv", "Sensors\na,b\n1,2\n")
    write(tmp_path / "d.csv", "2.csv", "Sensors\nb,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        A._titled_csv(spark, str(tmp_path / "d.csv"))


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_sniff(spark, tmp_path, sep):
    path = write(tmp_path, "d.csv", "\n".join(sep.join(r) for r in (["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"])))
    assert A.sniff_delimiter(spark, path) == sep


def test_sniff_falls_back_to_comma(spark, tmp_path):
    assert A.sniff_delimiter(spark, write(tmp_path, "d.csv", "a;b\n1\n2;3;4\n")) == ","


@pytest.mark.parametrize("content,reason,line,feature", [
    ("b,a\n0.1,0.2\n", None, None, None),
    ("﻿ b , x,a \n0.1,zz,1.0000000000000002\n", None, None, None),
    ('a,b\n"0.1","0.2"\n', None, None, None),
    ('a,b,note\n0.1,0.2,"x, ""y"""\n', None, None, None),
    ("a\n0.1\n", "missing_feature", None, None),
    ("a,b,a\n0.1,0.2,0.3\n", "duplicate_header", None, None),
    ("a,b, a\n0.1,0.2,0.3\n", "duplicate_header", None, None),
    ("a,b,\n0.1,0.2,0.3\n", "blank_header", None, None),
    ("a,b," + "x" * 200 + "\n0.1,0.2,0.3\n", "header_limit", None, None),
    ("a,b\n", "no_rows", None, None),
    ("a,b\n0.1,0.2\n\n0.3,0.4\n", "width", 3, None),
    ("a,b\n0.1\n", "width", 2, None),
    ("a,b\n0.1,0.2,0.3\n", "width", 2, None),
    ('a,b\n0.1,"0.2\n', "bad_quote", 2, None),
    ('a,b\n0.1,"0.2"x\n', "bad_quote", 2, None),
    (b"a,b\n0.1,0.2\n0.1,\xff\xfe\n", "invalid_utf8", 3, None),
    ("a,b\n0.1,0.2\n0.1,\n", "missing", 3, "b"),
    ("a,b\nword,0.2\n", "nonnumeric", 2, "a"),
    ("a,b\nNaN,0.2\n", "nonnumeric", 2, "a"),
    ("a,b\n0.1,0.2\n0.3,inf\n", "nonfinite", 3, "b"),
    ("a,b\n0.1,-0.2\n", "out_of_range", 2, "b"),
    ("a,b\n" + "0.1,0.2\n" * 5, "row_limit", None, None),
])
def test_strict_matrix(spark, tmp_path, content, reason, line, feature):
    path = write(tmp_path, "f.csv", content)
    r = A.strict_csv(spark, path, ["a", "b"], max_header=128, max_rows=4)
    v = r.verdict.first()
    assert (v["accepted"], v["reason"], v["first_line"], v["first_feature"]) == (reason is None, reason, line, feature)
    assert (r.rows.count() > 0) == (reason is None)


def test_bad_file_does_not_touch_the_others(spark, tmp_path):
    write(tmp_path, "good.csv", "b,extra,a\n" + "0.2,x,0.1\n" * 3)
    write(tmp_path, "bad.csv", "a,b\n0.1,0.2\n7,0.2\n")
    r = A.strict_csv(spark, str(tmp_path), ["a", "b"])
    verdict = {os.path.basename(v["file"]): v for v in r.verdict.collect()}
    assert verdict["good.csv"]["accepted"] and verdict["good.csv"]["ignored_columns"] == ["extra"] and not verdict["bad.csv"]["accepted"]
    assert [(x["line"], x["a"], x["b"]) for x in r.rows.orderBy("line").collect()] == [(2, 0.1, 0.2), (3, 0.1, 0.2), (4, 0.1, 0.2)]
    assert [(x["line"], x["feature"], x["kind"]) for x in r.issues.collect()] == [(3, "a", "out_of_range")]


def test_line_numbers_across_file_blocks(spark, tmp_path):
    path = write(tmp_path, "long.csv", "\n".join(["v"] + [f"{i:07d}" for i in range(1, 20001)]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = A.numbered_lines(spark, path).filter("line > 1").select("line", F.col("text").cast("int").alias("v"))
        assert rows.rdd.getNumPartitions() > 1
        assert rows.filter("line <> v + 1").count() == 0 and rows.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_table_choice(spark):
    spark.range(3).createOrReplaceTempView("just_a_view")
    with pytest.raises(ValueError, match="ordinary tables"):
        A.read_table(spark, "just_a_view")
    with pytest.raises(ValueError):
        A.read_table(spark, None)


def test_quoted_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 'say "x"', 0.5)], "obs int, code int, name string, confidence double")
    B.export_predictions(df, str(tmp_path / "out"), "obs", "code", "name", "confidence")
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first()
    assert back["Predicted name"] == 'say "x"' or '"x' in back["Predicted name"]


def sensor_rows(spark, n=240):
    c = (F.col("id") % 4).cast("int")
    return spark.range(n).select(F.col("id").alias("obs"), c.alias("y"), (c * 0.2 + F.rand(1) * 0.19).alias("a"), F.rand(2).alias("b"))


def test_snapshot_and_fingerprints(spark, tmp_path):
    assert B.load_snapshot(spark, str(tmp_path / "none")) is None
    train = str(tmp_path / "train")
    sensor_rows(spark).coalesce(1).write.parquet(train)
    found = A.file_fingerprints(spark, train + "/*.parquet")
    recorded = {r["name"]: r["sha256"] for r in found.collect()}
    B.check_fingerprints(found, recorded)
    with pytest.raises(ValueError, match="recorded fingerprints"):
        B.check_fingerprints(found, {k: "0" for k in recorded})
    df = spark.read.parquet(train)
    B.write_snapshot(B.snapshot_tables(df, ["a", "b"], "y", [0, 1, 2, 3]), str(tmp_path / "snap"))
    s = B.load_snapshot(spark, str(tmp_path / "snap"))
    same = G.drift(df, ["a", "b"], s["summary"], s["histogram"]).collect()
    assert {(r["total_variation"], r["outside_training_range"], r["shape_review"]) for r in same} == {(0.0, 0, False)}
    moved = G.drift(df.withColumn("a", F.col("a") / 3), ["a", "b"], s["summary"], s["histogram"]).filter("feature = 'a'").first()
    assert moved["shape_review"] and moved["outside_training_range"] > 0
    empty = G.drift(df.limit(0), ["a", "b"], s["summary"], s["histogram"]).first()
    assert empty["total_variation"] is None and empty["shape_review"] is False


FOREST = M.Candidate("forest", "forest", settings={"numTrees": 5, "maxDepth": 4})
BOOST = M.Candidate("boost", "boosting", balanced=False, settings={"maxIter": 3, "maxDepth": 3})


def stable(spark, tmp_path):
    sensor_rows(spark).write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


@pytest.mark.parametrize("candidate", [FOREST, BOOST], ids=["forest", "boosting"])
def test_saved_model_checks(spark, tmp_path, candidate):
    df = stable(spark, tmp_path)
    model = M.fit(candidate, df, ["a", "b"], "y", range(4))
    path = str(tmp_path / "model")
    B.save_model(model, path, df.agg(F.count("*").alias("rows")), df, lambda rows, m: M.probabilities(rows, m, range(4)))
    B.load_model(spark, path, ["a", "b"], range(4))
    for features, codes, message in ((["b", "a"], range(4), "feature order"), (["a", "b"], range(3), "classes")):
        with pytest.raises(ValueError, match=message):
            B.load_model(spark, path, features, codes)
    with pytest.raises(FileNotFoundError):
        B.load_model(spark, str(tmp_path / "nothing"), ["a"], range(4))


def test_preprocessing_is_fitted_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "a double")
    s = M.preprocessing_stats(train, ["a"]).first()
    assert (s["median"], s["mean"]) == (2.5, 2.5) and s["sd"] == pytest.approx(1.0)
    shifted = M.preprocess(train.withColumn("a", F.col("a") + 100), train, ["a"]).first()["a"]
    assert shifted == pytest.approx(98.5)


def test_cross_validation_learns_and_selects(spark, tmp_path):
    df = stable(spark, tmp_path)
    s = M.cv_summary(M.cross_validate(df, [M.Candidate("noise", "tree", balanced=False, features=("b",)), FOREST], ["a", "b"], "y", "obs", range(4), 3))
    assert M.select_best(s).first()["candidate"] == "forest"
    assert s.filter("candidate = 'forest'").first()["macro_f1_mean"] > 0.9
    with pytest.raises(ValueError, match="per class"):
        M.cross_validate(df.filter("y < 3"), [FOREST], ["a", "b"], "y", "obs", range(4), 3)


def test_permutation_importance_finds_the_feature(spark, tmp_path):
    df = stable(spark, tmp_path)
    model = M.fit(FOREST, df, ["a", "b"], "y", range(4))
    r = {x["feature"]: x["drop_mean"] for x in M.permutation_importance(model, df, ["a", "b"], "y", "obs", range(4), repeats=2).collect()}
    assert r["a"] > 0.4 > abs(r["b"])


def test_permuted_rows_keep_every_value(spark, tmp_path):
    df = stable(spark, tmp_path).select("obs", "a", "b")
    rows = M.permuted_rows(df, "obs", ["a", "b"], repeats=3)
    assert rows.count() == 240 * 6
    want = sorted(r["a"] for r in df.collect())
    for rep in range(3):
        got = rows.filter((F.col("rep") == rep) & (F.col("permuted") == "a")).select("a", "b", "obs").collect()
        assert sorted(r["a"] for r in got) == want


def assess(spark, tmp_path, change=lambda d: d, **options):
    df = stable(spark, tmp_path)
    model = M.fit(FOREST, df, ["a", "b"], "y", range(4))
    text = df.select(F.col("obs"), *[F.col(c).cast("string").alias(c) for c in ("a", "b", "y")])
    return W.assess(change(text), model, ["a", "b"], "obs", NAMES, "v1", "y", **options)


def test_assess_evaluate(spark, tmp_path):
    r = assess(spark, tmp_path, mode="evaluate", normalized=True, labels_confirmed=True)
    assert r["evaluation"].first()["accuracy"] > 0.8 and r["evaluation"].first()["independent_test"] is False
    assert r["summary"].first()["rows_analyzed"] == 240 and r["predictions"].count() == 240 and r["confusion"].count() == 16


@pytest.mark.parametrize("options,change,message", [
    ({"mode": "predict"}, lambda d: d, "normalization"),
    ({"mode": "predict", "normalized": True}, lambda d: d.withColumn("a", F.lit("7")), "Observation 0, a: out_of_range"),
    ({"mode": "evaluate", "normalized": True}, lambda d: d, "confirmation"),
    ({"mode": "evaluate", "normalized": True, "labels_confirmed": True}, lambda d: d.withColumn("y", F.lit("1.5")), "Labels"),
    ({"mode": "evaluate", "normalized": True, "labels_confirmed": True, "fingerprint": "f", "known": ("f",)}, lambda d: d, "known training"),
    ({"mode": "guess"}, lambda d: d, "Unknown mode")])
def test_assess_gates(spark, tmp_path, options, change, message):
    with pytest.raises(ValueError, match=message):
        assess(spark, tmp_path, change, **options)


def test_landing_stream_is_incremental(spark, tmp_path):
    df = stable(spark, tmp_path)
    model = M.fit(FOREST, df, ["a", "b"], "y", range(4))
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        q = land(spark, str(folder), "a STRING, b STRING", model, ["a", "b"], NAMES, "v1", str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"))
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count(), spark.read.parquet(str(tmp_path / "bad")).count()

    write(folder, "one.csv", "a,b\n0.1,0.2\n0.3,word\n")
    assert run() == (1, 1)
    assert run() == (1, 1)
    write(folder, "two.csv", "a,b\n0.5,0.2\n0.6,0.1\n")
    assert run() == (3, 1)
    write(folder, "three.csv", "b,note,a\r\n0.2,x,0.9\r\n0.2,x,0.9,7\r\n\r\n")
    write(folder, "four.csv", "a,c\n0.2,0.3\n")
    assert run() == (4, 3)
    got = spark.read.parquet(str(tmp_path / "out")).filter("source_file = 'three.csv'").first()
    assert (got["a"], got["b"]) == (0.9, 0.2)
    bad = spark.read.parquet(str(tmp_path / "bad")).selectExpr("source_file", "inline(problems)")
    assert {(r["source_file"], r["kind"]) for r in bad.collect()} == {("one.csv", "nonnumeric"), ("three.csv", "width"), ("four.csv", "missing_column")}
