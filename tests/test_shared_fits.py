"""Candidates of one fold share its fitted numbers, found in one set of passes for all folds."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import modeling as M


def sample(spark):
    rows = [(i, float(i * 7 % 31) if i % 13 else None, float(i % 5), i % 3 if i % 17 else None) for i in range(120)]
    return spark.createDataFrame(rows, "k int, a double, b double, y int")


def test_numbers_of_all_folds_equal_those_of_each(spark):
    data = M.with_folds(sample(spark), "y", "k", 3).persist()
    found = M.basics_without_fold(data, ["a", "b"], "y", 3)
    for i in range(3):
        alone = M.basics(data.filter(F.col("fold") != i), ["a", "b"], "y")
        assert found[i].counts == alone.counts
        for f in ("a", "b"):
            assert found[i].stats[f] == pytest.approx(alone.stats[f])


def test_cross_validation_fits_the_preprocessing_once(spark, monkeypatch):
    calls, real = [], M.preprocessing_stats
    monkeypatch.setattr(M, "preprocessing_stats", lambda *a, **k: calls.append(1) or real(*a, **k))
    cands = [M.Candidate("one", "logistic", scale=True, settings={"maxIter": 5}), M.Candidate("two", "tree", settings={"maxDepth": 2}, features=("a",))]
    scores = M.cross_validate(sample(spark).filter("y IS NOT NULL"), cands, ["a", "b"], "y", "k", [0, 1, 2], 3)
    assert scores.count() == 6 and len(calls) == 1
