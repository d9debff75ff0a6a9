"""Workflows: compositions of the operators, each a dictionary of result tables."""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.expr import col, cols
from tidegauge.functions.frames import attach
from tidegauge.functions.ordering import number_rows
from tidegauge.operators import association as A
from tidegauge.operators import binning as B
from tidegauge.operators import columns as P
from tidegauge.operators import contracts as C
from tidegauge.operators import dedup as D
from tidegauge.operators import distribution as G
from tidegauge.operators import evaluation as I
from tidegauge.operators import modeling as M
from tidegauge.operators import profile as E
from tidegauge.operators import scoring as R
from tidegauge.operators import splits as S
from tidegauge.operators import temporal as T
from tidegauge.operators import trees as Y
from tidegauge.session import cut_lineage, together
from tidegauge.sources import files as L
from tidegauge.sources import sinks as K


def clean(df: DataFrame, timestamp: str = "timestamp", tiebreak=()) -> tuple[DataFrame, DataFrame]:
    """Names, infinities, duplicates, time order, then fail on any null that is left. Returns (cleaned, report)."""
    C.require(C.non_empty(df))
    before = df.agg(F.count("*").alias("original_rows"), F.lit(len(df.columns)).alias("original_columns"))
    out = D.drop_duplicate_rows(P.infinite_to_null(P.normalize_names(df)))
    out = P.parse_and_sort(out, timestamp, tiebreak)
    left = E.overview(out).filter("n_null > 0").collect()
    if left:
        raise ValueError(f"Missing values remain after cleaning: { {r['column']: r['n_null'] for r in left} }")
    after = out.agg(F.count("*").alias("processed_rows"), F.lit(len(out.columns)).alias("processed_columns"))
    report = attach(before, after).withColumn("duplicates_removed", F.col("original_rows") - F.col("processed_rows"))
    types = [F.struct(F.lit(n).alias("column"), F.lit(t).alias("dtype")) for n, t in out.dtypes]
    return out, report.withColumn("data_types", F.array(*types))


def inspect(df: DataFrame, features, obs: str, target: str | None = None, codes=(), mapping: dict | None = None,
            low: float = 0.0, high: float = 1.0) -> dict[str, DataFrame]:
    """The inspection report of a text table; issues name the column as supplied."""
    mapping = mapping or {}
    frame = P.trim_names(df)
    data = P.rename_map(frame, mapping, features, target)
    present = [f for f in features if f in data.columns]
    body = frame.drop(obs)
    supplied = F.element_at(F.create_map(*[F.lit(x) for f in features for x in (f, mapping.get(f, f))]), F.col("feature"))
    out = {
        "columns": P.column_report(data.drop(obs), features, target),
        "duplicates": D.duplicate_count(body, out="duplicate_rows"),
        "blank": E.blank_counts(body),
        "issues": C.first_issues(data, present, obs, low=low, high=high).withColumn("column", supplied),
        "statistics": E.feature_statistics(data, present),
        "verdict": C.compatibility(data, features, low=low, high=high),
    }
    if len(present) == len(features):
        out["duplicate_features"] = D.duplicate_count(data.select(*cols(features)), out="duplicate_feature_rows")
    if target is not None and target in data.columns:
        out["labels"] = C.label_check(data, target, codes)
    return out


def dashboard(df: DataFrame, features, obs: str, label: str | None = None, codes=(), reference: dict | None = None,
              sample: bool = True) -> dict[str, DataFrame]:
    """Profile tables of a numeric or text table; unusable cells are counted and left out of the charts."""
    data = P.infinite_to_null(P.coerce_numeric(df, features))
    if label is not None:
        C.require(C.group_labels(data, label, codes))
    summary, histogram = G.feature_summary(data, features, label, codes), G.unit_histogram(data, features, label, codes)
    out = {"summary": summary, "histogram": histogram, "actual_range": G.range_histogram(data, features, label),
           "correlation": G.correlation_matrix(data, features, label), "quality": G.cell_quality(summary, histogram)}
    if label is not None:
        out["eta_squared"] = G.eta_squared(data, features, label)
        out["classes"] = G.class_share(data, label, codes)
    if sample:
        shown = data if label else data.withColumn("_class", F.lit(-1))
        n = max(1, shown.select(col(label or "_class")).distinct().count())
        out["sample"] = G.stratified_sample(shown.select(col(obs), col(label or "_class"), *cols(features)), label or "_class", obs, n)
    if reference is not None:
        out["comparison"] = G.drift(data, features, reference["summary"], reference["histogram"])
        out["warnings"] = G.quality_warnings(out["quality"], out["comparison"])
    else:
        out["warnings"] = G.quality_warnings(out["quality"])
    return out


def _series(df: DataFrame, timestamp: str, target: str, codes, order: str, test_size: float, tiebreak=()) -> tuple[DataFrame, DataFrame]:
    data = df if dict(df.dtypes)[timestamp] in ("timestamp", "timestamp_ntz") else P.parse_timestamp(df, timestamp)
    C.require(C.target_classes(data, target, codes))
    C.require(C.valid_timestamps(data, timestamp, order, tiebreak))
    return S.chronological_parts(data, [timestamp, *tiebreak], test_size)[:2]


def binary_signal(df: DataFrame, features, target: str, timestamp: str, test_size: float = 0.2, lags=T.LAGS,
                  min_cell: int = B.MIN_CELL, min_month: int = T.COMPLETE_MONTH_ROWS, tiebreak=()) -> dict[str, DataFrame]:
    """Associations of a binary target: features and bins from the earlier part, the later part only to compare.

    Rows may share a time only where `tiebreak` columns put them in order.
    """
    data, train = _series(df, timestamp, target, [0, 1], timestamp, test_size, tiebreak)
    ten, five = B.fit_edges(train, features, 10), B.fit_edges(train, features, 5)
    groups = A.two_group_summary(train, features, target)
    rates = B.binned_rates(data, ten, target, "part")
    summary = groups.join(A.cohens_d(groups), "feature").join(A.point_biserial(train, features, target), "feature")
    summary = summary.join(A.univariate_auc(train, features, target), "feature")
    summary = summary.join(A.mutual_information(train, features, target, edges=ten), "feature").join(B.rate_spread(rates), "feature")
    return {
        "features": A.rank_features(summary, "mutual_information", features),
        "pairs": B.pair_rate_deviation(data, five, target, "part", min_cell).orderBy(F.col("train_deviation").desc()),
        "binned_rates": rates,
        "monthly_rate": T.monthly_rate(data, timestamp, target, min_month),
        "monthly_means": T.monthly_means(data, timestamp, features, target, min_month),
        "autocorrelation": T.autocorrelation(number_rows(train.select(*cols([timestamp, *tiebreak, target])), [timestamp, *tiebreak]), "obs", target, lags),
        "parts": data.groupBy("part").agg(F.count("*").alias("n"), F.avg(col(target).cast("double")).alias("rate")),
    }


def class_signal(df: DataFrame, features, label: str, names: dict, timestamp: str, leakage=(), test_size: float = 0.2, lags=T.LAGS,
                 min_cell: int = B.MIN_CELL, min_month: int = T.COMPLETE_MONTH_ROWS, tiebreak=()) -> dict[str, DataFrame]:
    """Associations of a class target, with the same split discipline."""
    codes = list(names)
    data, train = _series(df, timestamp, label, codes, timestamp, test_size, tiebreak)
    ten, five = B.fit_edges(train, features, 10), B.fit_edges(train, features, 5)
    summary = G.eta_squared(train, features, label, undefined_zero=True)
    summary = summary.join(A.auc_summary(A.one_vs_rest_auc(train, features, label, codes)), "feature")
    summary = P.lookup_names(summary, "best_class", names, "best_class_name")
    summary = summary.join(A.mutual_information(train, features, label, edges=ten), "feature")
    return {
        "distribution": B.class_distribution(data, label, codes, "part", names),
        "features": A.rank_features(summary, ["mutual_information", "eta_squared"], features),
        "class_features": A.class_summary(train, features, label),
        "pairs": B.pair_class_pattern(data, five, label, codes, "part", min_cell).orderBy(F.col("train_deviation").desc()),
        "binned_rates": B.class_rates_by_bin(data, ten, label, codes, "part"),
        "monthly_shares": T.monthly_class_shares(data, timestamp, label, names, min_month),
        "autocorrelation": T.class_autocorrelation(number_rows(train.select(*cols([timestamp, *tiebreak, label])), [timestamp, *tiebreak]), "obs", label, codes, lags),
        "leakage": A.leakage_summary(train, leakage, features, label),
    }


def training_signal(train: DataFrame, features, label: str, key: str, codes, folds: int = M.FOLDS) -> dict[str, DataFrame]:
    """Training-only associations and shallow rules; label codes are never treated as numbers."""
    cuts = Y.fit_cuts(train, features)
    # The tables do not depend on each other, and most of them run short jobs while they are put together.
    (rules, rule_scores), univariate, information, eta, auc, classes, correlation = together(train.sparkSession, [
        lambda: Y.cross_validate_tree(train, features, label, key, codes, folds, cuts=cuts),
        lambda: Y.univariate_tree_scores(train, features, label, key, codes, folds, cuts=cuts),
        lambda: A.mutual_information(train, features, label),
        lambda: G.eta_squared(train, features, label, undefined_zero=True),
        lambda: A.one_vs_rest_auc(train, features, label, codes),
        lambda: A.class_summary(train, features, label),
        lambda: G.correlation_matrix(train, features),
    ])
    return {
        "associations": eta.join(information, "feature").join(univariate, "feature"),
        "class_auc": auc,
        "class_features": classes,
        "rule_scores": M.cv_summary(rule_scores, ("macro_f1",)),
        "rules": rules.table(train.sparkSession),
        "correlation": correlation,
    }


def baseline(df: DataFrame, features, target: str, order_by, test_size: float = 0.2, max_iter: int = 1000) -> DataFrame:
    """model and binary test metrics of the majority class and the balanced logistic regression, earlier part against later."""
    C.require(C.binary_target(df, target))
    # Both parts are filters that reach the scan, and only the features and the target go on: fit() holds what it reads again.
    parts = S.chronological_parts(df.withColumn(target, col(target).cast("int")), order_by, test_size)[1:]
    train, test = [part.select(*cols(dict.fromkeys([*features, target]))) for part in parts]
    model = M.fit(M.Candidate("logistic_regression", "logistic", scale=True, settings={"maxIter": max_iter}), train, features, target, [0, 1])
    fitted = M.probabilities(test, model, [0, 1]).select(col(target), F.col("p")[1].alias("_fitted"))
    models = [F.struct(F.lit("logistic_regression").alias("model"), F.col("_fitted").alias("score"), (F.col("_fitted") > 0.5).cast("int").alias("yhat")),
              F.struct(F.lit("majority").alias("model"), "score", "yhat")]
    # Scored once, then read by every metric.
    scored = cut_lineage(M.majority_scores(train, fitted, target).select(col(target), F.inline(F.array(*models))))
    return I.binary_metrics(scored, target, "yhat", "score", ["model"])


def notebook_baseline(df: DataFrame, features, target: str, order_by, trees: int = 100, depth: int = 12, leaf: int = 20) -> DataFrame:
    """model, part, metrics: logistic regression in-sample and on test, forest on the nested validation part."""
    # Only what the models read is held.
    data = S.nested_split(df.withColumn(target, col(target).cast("int")), order_by).select(*cols(dict.fromkeys([*features, target])), "part").persist()
    train, test = data.filter("part <> 'test'"), data.filter("part = 'test'")
    inner, validation = data.filter("part = 'fit'"), data.filter("part = 'validation'")
    lr = M.fit(M.Candidate("lr", "logistic", scale=True, settings={"maxIter": 1000}), train, features, target, [0, 1])
    rf = M.fit(M.Candidate("rf", "forest", settings={"numTrees": trees, "maxDepth": depth, "minInstancesPerNode": leaf}), inner, features, target, [0, 1])
    scored = None
    for name, model, part, rows in (("logistic_regression", lr, "train", train), ("logistic_regression", lr, "test", test),
                                    ("random_forest", rf, "validation", validation)):
        one = M.probabilities(rows.drop("part"), model, [0, 1]).select(F.lit(name).alias("model"), F.lit(part).alias("rows_of"), col(target), F.col("p")[1].alias("score"))
        scored = one if scored is None else scored.unionByName(one)
    scored = cut_lineage(scored.withColumn("yhat", (F.col("score") > 0.5).cast("int")))
    data.unpersist()
    return I.binary_metrics(scored, target, "yhat", "score", ["model", "rows_of"])


def explain(train: DataFrame, candidate: M.Candidate, features, label: str, key: str, codes, repeats: int = 10) -> dict[str, DataFrame]:
    """Permutation and impurity importances on one training-only validation fold."""
    data = M.with_folds(train, label, key).persist()
    model = M.fit(candidate, data.filter("fold <> 0"), features, label, codes)
    validation = data.filter("fold = 0").select(*cols(features), col(label).cast("int").alias(label), col(key))
    out = {"permutation": M.permutation_importance(model, validation, features, label, key, codes, repeats)}
    if candidate.kind in ("forest", "tree"):
        out["impurity"] = M.impurity_importance(model, train.sparkSession, features)
    return out


def experiment(paths: dict[str, str], features, target: str, names: dict, out: str, spark, cands=None, repeats: int = 10,
               folds: int = M.FOLDS) -> dict[str, DataFrame]:
    """Fingerprint, audit, training signal, select on training folds, then fit, evaluate once on test, persist and verify.

    The audit, the signal, the selection and a manifest (input hashes, configurations, choice, importances, version)
    are written before any test row is scored. Every candidate gets its test metrics, confusion table and class report.
    """
    codes, cands = list(names), cands or M.candidates()
    before = cut_lineage(L.file_fingerprints(spark, list(paths.values())))
    data = with_row_ids(L.load_split_group(spark, paths, features, target))
    data = cut_lineage(data)
    audit = E.audit_features(data.drop("obs"), features, "part", "training")
    train, test = data.filter("part = 'training'").drop("part"), data.filter("part = 'testing'").drop("part")
    K.write_report(audit, f"{out}/audit")
    signal = {f"signal_{k}": v for k, v in training_signal(train, features, target, "obs", codes, folds).items()}
    together(spark, [partial(K.write_report, table, f"{out}/{name}") for name, table in signal.items()])
    summary = M.cv_summary(cut_lineage(M.cross_validate(train, cands, features, target, "obs", codes, folds)))
    K.write_report(summary, f"{out}/selection_before_test")
    chosen = M.select_best(summary).first()["candidate"]
    trees = [c.name for c in cands if c.kind in ("forest", "tree", "boosting")]
    best_tree = M.select_best(summary, among=trees).first()["candidate"]
    importance = explain(train, next(c for c in cands if c.name == best_tree), features, target, "obs", codes, repeats)
    importance["permutation"] = cut_lineage(importance["permutation"])
    manifest = before.agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("inputs"))
    manifest = attach(manifest, importance["permutation"].agg(F.array_sort(F.collect_list(F.struct("feature", "drop_mean", "drop_sd"))).alias("permutation_importance")))
    settings = {"selected": chosen, "best_tree": best_tree, "target": target, "folds": folds, "repeats": repeats, "spark_version": spark.version,
                "candidates": json.dumps([asdict(c) for c in cands])}
    manifest = manifest.withColumns({"features": F.array(*[F.lit(f) for f in features])} | {k: F.lit(v) for k, v in settings.items()})
    manifest = cut_lineage(manifest)
    K.write_report(manifest, f"{out}/manifest")
    models, scored = M.fit_and_score(cands, train, test, features, target, codes)
    scored = I.argmax_class(scored.withColumn(target, col(target).cast("int")), "p", codes, "_yhat")
    # Scored once for all tables of results.
    scored = cut_lineage(scored.select("candidate", col(target), "p", "_yhat"))
    results = test_results(scored, target, codes)
    K.save_model(models[chosen], out, attach(results, manifest), test.select(*cols(features), "obs"),
                 lambda rows, model: R.score_table(M.probabilities(rows, model, codes), "p", names))
    K.require_unchanged(before, L.file_fingerprints(spark, list(paths.values())))
    return {"audit": audit, "selection": summary, "manifest": manifest, "results": results.withColumn("selected", F.col("candidate") == chosen),
            "confusion": I.confusion(scored, target, "_yhat", codes, ["candidate"]),
            "class_report": I.class_report(scored, target, "_yhat", codes, ["candidate"]), **signal, **importance}


def test_results(scored: DataFrame, target: str, codes) -> DataFrame:
    """candidate and its test metrics."""
    return I.macro_metrics(scored, target, "_yhat", codes, ["candidate"]).join(
        I.macro_auc(scored, target, "p", codes, ["candidate"]), ["candidate"])


def with_row_ids(df: DataFrame, out: str = "obs") -> DataFrame:
    """A unique id for tables without one; equal rows still get different ids.

    The frame must be written right after (see cut_lineage) so that the ids stay fixed.
    """
    return df.withColumn(out, F.monotonically_increasing_id())


def assess(df: DataFrame, model, features, obs: str, names: dict, version: str, target: str | None = None, mapping: dict | None = None,
           mode: str = "inspect", normalized: bool = False, labels_confirmed: bool = False, reference: dict | None = None,
           fingerprint: str | None = None, known: tuple = ()) -> dict[str, DataFrame]:
    """Inspect, predict or evaluate a text table; scoring needs explicit confirmations.

    predict and evaluate reject the whole table on any incompatible cell, and
    evaluate also on any invalid label or a known training fingerprint.
    """
    codes = list(names)
    report = inspect(df, features, obs, target, codes, mapping)
    data = P.rename_map(P.trim_names(df), mapping or {}, features, target)
    if mode == "inspect":
        labels = target if labels_confirmed and "labels" in report and report["labels"].first()["evaluable"] else None
        rows = data.withColumn(target, col(target).cast("double").cast("int")) if labels else data
        if all(f in rows.columns for f in features):
            report.update(dashboard(rows, features, obs, labels, codes, reference))
        return report
    if mode not in ("predict", "evaluate"):
        raise ValueError(f"Unknown mode: {mode}")
    verdict = report["verdict"].first()
    if not verdict["compatible"]:
        first = [f"Observation {r['obs']}, {r['feature']}: {r['kind']}" for r in report["issues"].collect()]
        raise ValueError(". ".join(["Missing features, invalid cells or empty data; no predictions generated", *first]))
    if not normalized:
        raise ValueError("Confirm compatible normalization before prediction")
    if mode == "evaluate":
        if not labels_confirmed or target is None or target not in data.columns:
            raise ValueError("Evaluation requires the label column and confirmation of its meaning")
        if fingerprint is not None and fingerprint in known:
            raise ValueError("This is a known training dataset; it cannot be evaluated independently")
        if not report["labels"].first()["evaluable"]:
            raise ValueError("Labels must be documented integer codes; no rows evaluated")
    typed = P.coerce_numeric(data, features)
    keep = [obs] + ([target] if mode == "evaluate" else [])
    scored = R.score_batch(typed, model, features, names, keep, strict=False)
    records = R.prediction_records(scored, names, version)
    report["predictions"] = records
    report["first_predictions"] = G.first_rows(records, obs)
    report["summary"] = R.batch_summary(records, names)
    report["classes"] = G.class_share(records, "code", codes)
    if mode == "evaluate":
        rows = scored.withColumn("_y", col(target).cast("double").cast("int"))
        rows = rows.withColumn("p", F.array(*[F.col(f"probability_{c}") for c in codes]))
        report["evaluation"] = I.evaluate(rows, "_y", "code", "p", codes)
        report["confusion"] = I.confusion(rows, "_y", "code", codes)
        report["reliability"] = I.reliability(rows, "_y", "p", codes)
    return report


def score_files(spark, paths, model, features, names: dict, version: str, sep: str | None = None, reference: dict | None = None,
                limit: int = 1000) -> dict[str, DataFrame]:
    """Strict text files to predictions, batch summary and profile.

    Each file is accepted or rejected as a whole. Rows of accepted files are read and scored once, into a written table,
    and keep their file and line; `obs` joins the two. The profile is grouped by predicted class.
    """
    codes = list(names)
    files = L.strict_csv(spark, paths, features, sep)
    rows = files.rows.withColumn("obs", F.concat_ws("#", "file", col("line").cast("string")))
    scored = cut_lineage(R.score_batch(rows, model, features, names, ["file", "line", "obs"], strict=False))
    records = R.prediction_records(scored, names, version)
    out = {"verdict": files.verdict, "issues": files.issues, "predictions": records, "first_predictions": records.orderBy("file", "line").limit(limit),
           "batch": R.batch_summary(records, names, limit=limit)}
    # Without one accepted row there is nothing to profile.
    return out if scored.isEmpty() else {**out, **dashboard(scored, features, "obs", "code", codes, reference)}
