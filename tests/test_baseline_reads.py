"""Baselines hold nothing once they are done, and score each row once."""

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import ordering as O
from tidegauge.operators import modeling as M
from tidegauge.plans import workflows as W


def series(spark):
    rows = spark.range(400).select("id", F.md5(F.col("id").cast("string")).alias("wide"), F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 101).cast("double").alias("a"),
                                   (F.col("id") % 5).cast("double").alias("b"))
    return rows.withColumn("y", (F.coalesce("a", F.lit(50.0)) + F.col("id") % 11 > 55).cast("int"))


@pytest.mark.parametrize("run", [lambda df: W.baseline(df, ["a", "b"], "y", "id", max_iter=20),
                                 lambda df: W.notebook_baseline(df, ["a", "b"], "y", "id", trees=2, depth=2, leaf=5)])
def test_rows_are_scored_once_and_let_go(spark, monkeypatch, run):
    scored, real = spark.sparkContext.accumulator(0), M.probabilities

    def counted(batches):
        for b in batches:
            scored.add(b.num_rows)
            yield b

    def probabilities(df, *args):
        out = real(df, *args)
        return out.mapInArrow(counted, out.schema)

    monkeypatch.setattr(M, "probabilities", probabilities)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = run(series(spark)).collect()
    assert scored.value == sum(r["n"] for r in found if r["model"] != "majority")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_numbers_of_the_baseline(spark):
    found = {r["model"]: r for r in W.baseline(series(spark), ["a", "b"], "y", "id", max_iter=50).collect()}
    y = [r["y"] for r in series(spark).orderBy("id").collect()]
    top = int(sum(y[:320]) * 2 > 320)
    assert found["majority"]["n"] == found["logistic_regression"]["n"] == 80
    assert found["majority"]["accuracy"] == pytest.approx(sum(v == top for v in y[320:]) / 80) and found["majority"]["roc_auc"] == 0.5
    assert found["logistic_regression"]["roc_auc"] > 0.8


def test_statistics_without_a_row_per_feature(spark, monkeypatch):
    """Each row of the table comes once to the means and deviations; a feature without a value has no statistics."""
    df = series(spark).withColumn("none", F.lit(None).cast("double")).withColumn("k", F.col("id") % 2)
    long = []
    monkeypatch.setattr(M, "to_long", lambda t, *a, real=M.to_long: long.append(1) or real(t, *a))
    found = {(r["k"], r["feature"]): r for r in M.preprocessing_stats(df, ["a", "b", "none"], ["k"]).collect()}
    assert set(found) == {(k, f) for k in (0, 1) for f in ("a", "b")} and len(long) == 1
    for k in (0, 1):
        values = [r["a"] for r in df.filter(F.col("k") == k).collect()]
        known = sorted(v for v in values if v is not None)
        median = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
        whole = [median if v is None else v for v in values]
        mean = sum(whole) / len(whole)
        assert found[k, "a"]["median"] == median and found[k, "a"]["mean"] == pytest.approx(mean)
        assert found[k, "a"]["sd"] == pytest.approx((sum((v - mean) ** 2 for v in whole) / len(whole)) ** 0.5)


def test_ranks_search_cells_only_near_them(spark, monkeypatch):
    """Values far from every open cell are not looked up, so features that are solved at once cost one pass."""
    joined, real = spark.sparkContext.accumulator(0), O.same_cell

    def counted(batches):
        for b in batches:
            joined.add(b.num_rows)
            yield b

    def same_cell(rows, *args):
        return real(rows.mapInArrow(counted, rows.schema) if "_v" in rows.columns else rows, *args)

    monkeypatch.setattr(O, "same_cell", same_cell)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "wide").otherwise("few").alias("k"),
                                    F.when(F.col("id") % 3 == 0, 1000.0 + F.col("id")).otherwise(F.col("id") % 3 * 1.0).alias("v"))
    found = {r["k"]: r["q"][0] for r in O.quantiles(rows, ["k"], "v", [0.5]).collect()}
    assert found == {"wide": 1000.0 + 1498.5, "few": 1.5}
    assert joined.value < 1000
