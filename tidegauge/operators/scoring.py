"""Batch scoring, prediction records, batch summaries and guidance lookups."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.expr import col, cols
from tidegauge.functions.frames import attach
from tidegauge.operators.contracts import bad_probabilities, require, strict_frame
from tidegauge.operators.distribution import class_share, dominant_abnormal
from tidegauge.operators.evaluation import argmax_class
from tidegauge.operators.modeling import probabilities


def _names(names: dict):
    return F.create_map(*[F.lit(x) for p in names.items() for x in p])


def score_table(df: DataFrame, p: str, names: dict) -> DataFrame:
    """code, name and probability_<code> columns from a probability array in code order."""
    codes = list(names)
    out = argmax_class(df, p, codes, "code").withColumn("name", F.element_at(_names(names), F.col("code")))
    return out.withColumns({f"probability_{c}": col(p)[i] for i, c in enumerate(codes)}).drop(p)


def score_batch(df: DataFrame, model: PipelineModel, features, names: dict, keep=(), strict: bool = True) -> DataFrame:
    """Score named columns in the model's own order; strict checks the whole batch first."""
    inputs = df.select(*cols(keep), *cols(features))
    if strict:
        require(strict_frame(inputs.select(*cols(features)), features))
    return score_table(probabilities(inputs, model, list(names)), "p", names)


def prediction_records(scored: DataFrame, names: dict, version: str, normal=0) -> DataFrame:
    """Adds confidence (probability of the predicted class), class_probabilities, status and model_version.

    A probability vector that is not finite, non-negative and summing to 1 fails the job.
    """
    codes = list(names)
    p = F.array(*[F.col(f"probability_{c}") for c in codes])
    own = F.element_at(F.map_from_arrays(F.array(*[F.lit(c) for c in codes]), p), F.col("code"))
    out = scored.withColumn("_p", p)
    checked = F.when(bad_probabilities("_p", len(codes)), F.raise_error(F.lit("Invalid class probabilities")).cast("double")).otherwise(own)
    return out.withColumns({
        "confidence": checked,
        "class_probabilities": F.map_from_arrays(F.array(*[F.lit(n) for n in names.values()]), F.col("_p")),
        "status": F.when(F.col("code") == normal, F.lit("normal")).otherwise(F.lit("fault_detected")),
        "model_version": F.lit(version),
    }).drop("_p")


def batch_summary(records: DataFrame, names: dict, normal=0, limit: int = 1000) -> DataFrame:
    """One row over the whole batch: rows, rows returned, truncation, dominant abnormal class and mean confidence."""
    totals = records.agg(F.count("*").alias("rows_analyzed"), F.avg("confidence").alias("mean_confidence"))
    totals = totals.withColumn("predictions_returned", F.least("rows_analyzed", F.lit(limit).cast("bigint")))
    totals = totals.withColumn("truncated", F.col("rows_analyzed") > limit)
    return attach(totals, dominant_abnormal(class_share(records, "code", list(names)), names, normal))


def attach_guidance(records: DataFrame, rules: DataFrame, code: str, sensors) -> DataFrame:
    """Causes, checks and priority of the predicted class, and the readings of that rule's sensors.

    `rules` has one row per class (code, sensors, causes, checks, priority), so it is broadcast.
    """
    readings = F.map_from_arrays(F.array(*[F.lit(s) for s in sensors]), F.array(*[col(s).cast("double") for s in sensors]))
    rule = rules.select(F.col("code").alias(code), F.col("sensors").alias("_sensors"), "causes", "checks", "priority")
    out = records.join(F.broadcast(rule), code, "left")
    return out.withColumn("observed", F.map_filter(readings, lambda k, v: F.array_contains("_sensors", k))).drop("_sensors")
