"""Curves count their rows in one scan: the totals come with the prefix sums."""

from pyspark.sql import functions as F

from tidegauge.functions import ordering as O
from tidegauge.operators import evaluation as I


def test_prefix_sums_carry_totals(spark):
    rows = spark.range(500).selectExpr("id % 3 AS k", "id", "id % 4 AS n")
    for r in O.prefix_sums(rows, ["k"], "id", ["n"]).collect():
        assert r["total_n"] == sum(i % 4 for i in range(500) if i % 3 == r["k"])


def test_rows_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("CAST(id % 2 AS INT) AS y", "id * 0.5D AS s").mapInArrow(counted, "y int, s double")
    found = I.score_metrics(df.withColumn("one", F.lit(1)), ["one"], "y", "s").first()
    assert abs(found["roc_auc"] - 0.501) < 1e-9 and seen.value == 1000
