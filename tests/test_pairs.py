"""Sums over feature pairs against numpy, with nulls, unknown groups and flushed tables."""

from itertools import combinations

import numpy as np
import pytest

from tidegauge.functions import pairs as P
from tidegauge.operators import binning as B
from tidegauge.operators import distribution as D

NAMES = ["a b", "c", "d.e", "flat"]


def table(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(1e6, 1, (n, 4))
    x[:, 3] = 0.1
    x[rng.random((n, 4)) < 0.1] = np.nan
    x[0, 0], x[1, 1] = np.inf, -np.inf
    return x, [None if k == 5 else f"g{k}" for k in rng.integers(0, 6, n)]


@pytest.mark.parametrize("held", [1 << 23, 1])
def test_correlation_of_every_pair_and_group(spark, monkeypatch, held):
    monkeypatch.setattr(P, "HELD", held)
    x, g = table()
    rows = [(None if np.isnan(a) else float(a), float(b), float(c), None if np.isnan(d) else float(d), k) for (a, b, c, d), k in zip(x, g)]
    df = spark.createDataFrame(rows, "`a b` double, c double, `d.e` double, flat double, k string")
    got = {(r.grp, r.feature_a, r.feature_b): (r.r, r.n) for r in D.correlation_matrix(df, NAMES, "k").collect()}
    for grp in {"all", *(k for k in g if k)}:
        mine = x if grp == "all" else x[[k == grp for k in g]]
        for i, a in enumerate(NAMES):
            for j, b in enumerate(NAMES):
                u, v = mine[np.isfinite(mine[:, i]) & np.isfinite(mine[:, j])][:, [i, j]].T
                r, n = got.pop((grp, a, b))
                assert n == len(u)
                assert (r is None) == (3 in (i, j)) and (r is None or abs(r - np.corrcoef(u, v)[0, 1]) < 1e-9)
    assert not got


@pytest.mark.parametrize("held, kind", [(1 << 23, "int"), (1, "bigint")])
def test_counts_of_every_pair_of_bins(spark, monkeypatch, held, kind):
    monkeypatch.setattr(P, "HELD", held)
    rng = np.random.default_rng(3)
    rows = [(*(None if v == 4 else int(v) for v in rng.integers(0, 5, 3)), int(k) if k else None, float(y)) for k, y in zip(rng.integers(0, 3, 500), rng.normal(0, 1, 500))]
    df = spark.createDataFrame(rows, f"a int, b int, c int, k {kind}, y double")
    want = {}
    for r in rows:
        for i, j in combinations(range(3), 2):
            if r[i] is not None and r[j] is not None:
                n, s = want.get(("abc"[i], "abc"[j], r[3], r[i], r[j]), (0, 0.0))
                want["abc"[i], "abc"[j], r[3], r[i], r[j]] = n + 1, s + r[4]
    got = {(r.feature_a, r.feature_b, r.k, r.a, r.b): (r.n, r.total) for r in P.pair_counts(df, ["a", "b", "c"], "k", 4, "y").collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and abs(got[k][1] - s) < 1e-9 for k, (n, s) in want.items())


def test_no_plan_makes_a_row_per_pair(spark):
    df = spark.range(50).selectExpr("id / 50 AS a", "id % 7 / 7 AS b", "id % 3 / 3 AS c", "id % 2 AS k", "IF(id < 40, 'train', 'test') AS part")
    edges = {n: [0.0, 0.5, 1.0] for n in "abc"}
    for out in (D.correlation_matrix(df, list("abc"), "k"), D.joint_bins(df, list("abc"), "k"), B.pair_rate_deviation(df, edges, "k", "part"), B.pair_class_pattern(df, edges, "k", [0, 1], "part")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("MapInArrow"):]
        assert "Generate" not in below and "Expand" not in below


def test_empty_tables_and_single_features(spark):
    df = spark.range(0).selectExpr("id / 50 AS a", "id / 2 AS b", "id AS k")
    assert D.correlation_matrix(df, ["a", "b"], "k").count() == 0 and D.joint_bins(df, ["a", "b"], "k").count() == 0
    assert D.joint_bins(spark.range(5).selectExpr("id / 5 AS a", "id AS k"), ["a"], "k").count() == 0
