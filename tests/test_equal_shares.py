"""Rows whose weights differ although their shares are equal after the division."""

from tidegauge.bindings import evaluation as B
from tidegauge.bindings.registry import QUERIES, Tables

LINES = [(45.0, 76502.08, 0.07, 0.08), (27.0, 53251.63, 0.07, 0.02), (30.0, 19702.79, 0.09, 0.01), (30.0, 15967.88, 0.09, 0.01)]


def test_the_class_goes_by_the_weights(spark, tmp_path):
    rows = [(*v, "A", "F", i, 1, 1, 1) for i, v in enumerate(LINES)]
    df = spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                                     "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").selectExpr("*", "TIMESTAMP_NTZ '2000-01-01' AS l_shipdate")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    weights = [(q + 1, p / 2000 + 1, 300 * (d + t) + 1) for q, p, d, t in LINES]
    whole = [a + b + c for a, b, c in weights]
    assert all(w[0] != w[2] and w[0] / s == w[2] / s for w, s in zip(weights, whole))
    want = sorted(w.index(max(w)) for w in weights)
    assert sorted(r["pred"] for r in B.scored(Tables(spark, str(tmp_path))).collect()) == want
    assert {(r["pred"], r["n"]) for r in QUERIES["i13_argmax"](spark, str(tmp_path)).collect()} == {(c, want.count(c)) for c in want}
