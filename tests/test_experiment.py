"""The experiment writes its evidence before test rows are scored, and reports every candidate."""

import json

import pytest

from tidegauge.bindings import load
from tidegauge.bindings.common import FAULT_NAMES, SENSORS
from tidegauge.bindings.registry import Tables
from tidegauge.bindings.sources import split_files
from tidegauge.operators import modeling as M
from tidegauge.plans import workflows as W
from tidegauge.sources import sinks as K


def test_experiment_reports_and_manifest(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    cands = [M.Candidate("logistic", "logistic", scale=True, settings={"maxIter": 20}), M.Candidate("rules", "tree", balanced=False, settings={"maxDepth": 2})]
    out = W.experiment(split_files(t), SENSORS, "cls", FAULT_NAMES, str(tmp_path / "run"), spark, cands, repeats=1, folds=2)
    manifest = out["manifest"].first()
    assert len(manifest["inputs"]) == 3 and len({i["path"] for i in manifest["inputs"]}) == 3
    assert [c["name"] for c in json.loads(manifest["candidates"])] == ["logistic", "rules"] and manifest["best_tree"] == "rules"
    assert sorted(i["feature"] for i in manifest["permutation_importance"]) == sorted(SENSORS)
    for folder in ("audit", "signal_associations", "signal_rules", "selection_before_test", "manifest", "metadata", "model"):
        assert (tmp_path / "run" / folder).is_dir()
    confusion = out["confusion"].groupBy("candidate").sum("n").collect()
    report = {(r["candidate"], r["label"]): r for r in out["class_report"].collect()}
    assert {r["candidate"] for r in confusion} == {"logistic", "rules"} and len(report) == 2 * (len(FAULT_NAMES) + 2)
    for r in confusion:
        assert report[r["candidate"], "macro avg"]["support"] == r["sum(n)"]
    results = {r["candidate"]: r for r in out["results"].collect()}
    for name, r in results.items():
        assert report[name, "macro avg"]["f1"] == pytest.approx(r["macro_f1"])
    assert results[manifest["selected"]]["selected"]


def test_changed_files_are_found_by_whole_path(spark):
    before = spark.createDataFrame([("a/x.csv", "1"), ("b/x.csv", "2")], "path string, sha256 string")
    K.require_unchanged(before, before)
    swapped = spark.createDataFrame([("a/x.csv", "2"), ("b/x.csv", "1")], "path string, sha256 string")
    with pytest.raises(ValueError, match="a/x.csv"):
        K.require_unchanged(before, swapped)
    with pytest.raises(ValueError, match="b/x.csv"):
        K.require_unchanged(before, before.filter("path = 'a/x.csv'"))


def test_registered_experiment_compares_whole_candidates(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(W, "experiment", lambda paths, features, target, names, out, spark, cands=None, **more: seen.update(cands=cands, **more) or {"results": spark.range(1)})
    load()[0]["m22_experiment"](spark, "/root/testdata/sf0.001")
    assert {c.name: c.settings for c in seen["cands"] or M.candidates()} == {
        "logistic_regression": {"maxIter": 2000}, "random_forest": {"numTrees": 200, "maxDepth": 20}, "gradient_boosting": {"maxIter": 150, "maxDepth": 5, "stepSize": 0.1}}
    assert (seen["repeats"], seen["folds"]) == (10, 5)


@pytest.mark.parametrize("rows, tasks", [(1 << 15, 1), (40, 4)])
def test_boosting_starts_no_task_for_a_few_rows(spark, monkeypatch, rows, tasks):
    seen, real = [], M.GBTClassifier.fit
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or real(self, df))
    monkeypatch.setattr(M, "TASK_ROWS", rows)
    train = spark.createDataFrame([(float(i % 7), i // 50) for i in range(150)], "a double, y int").repartition(8)
    model = M.fit(M.Candidate("b", "boosting", balanced=False, settings={"maxIter": 2, "maxDepth": 2}), train, ["a"], "y", [0, 1, 2])
    assert seen == [tasks] * 3
    assert [s.getProbabilityCol() for s in model.stages[-3:]] == [f"_prob_{c}" for c in range(3)]  # in class order
    assert M.probabilities(train, model, [0, 1, 2]).filter("size(p) = 3").count() == 150
