"""Writers: cleaned tables, reports, exports, models and the aggregate snapshot."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.expr import cols
from tidegauge.functions.frames import attach
from tidegauge.operators import distribution as D

SNAPSHOT_TABLES = ("summary", "histogram", "correlation", "eta_squared", "joint_bins", "quality")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cleaned table without an index; parquet unless CSV is asked for."""
    if fmt == "csv":
        df.write.mode("errorifexists").csv(path, header=True)
    else:
        df.write.mode("errorifexists").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report table as JSON documents, one per row."""
    df.write.mode("errorifexists").json(path)


def export_predictions(df: DataFrame, path: str, obs: str, code: str, name: str, confidence: str) -> None:
    """Observation number, class, name and confidence; every cell is quoted."""
    out = df.select(*cols([obs, code, name, confidence])).toDF("Observation #", "Predicted class", "Predicted name", "Model confidence (0-1)")
    out.write.mode("errorifexists").option("quoteAll", True).csv(path, header=True)


def summary_export(summary: DataFrame, source: str, scope: str, basis: str, group: str = "all") -> DataFrame:
    """The per-feature summary of one class filter with its source, scope and label basis."""
    s = summary.filter(F.col("grp") == group)
    return s.select(F.lit(source).alias("source"), F.lit(scope).alias("scope"), F.lit(basis).alias("label_basis"), F.lit(group).alias("class_filter"),
                    "feature", "n", "excluded", "min", "q1", "median", "q3", "max", "mean", "sd")


def export_summary(summary: DataFrame, path: str, **labels) -> None:
    summary_export(summary, **labels).write.mode("errorifexists").option("quoteAll", True).csv(path, header=True)


def document(tables: dict[str, DataFrame], **labels) -> DataFrame:
    """One nested row holding each (small, aggregate) table as an array of records."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.array_sort(F.collect_list(F.struct(*cols(t.columns)))).alias(name))
        out = one if out is None else attach(out, one)
    return out.select(*[F.lit(v).alias(k) for k, v in labels.items()], *tables)


def snapshot_tables(df: DataFrame, features, label: str, codes) -> dict[str, DataFrame]:
    """Aggregates only, no raw rows."""
    summary, histogram = D.feature_summary(df, features, label, codes), D.unit_histogram(df, features, label, codes)
    return {"summary": summary, "histogram": histogram, "correlation": D.correlation_matrix(df, features, label),
            "eta_squared": D.eta_squared(df, features, label), "joint_bins": D.joint_bins(df, features, label),
            "quality": D.cell_quality(summary, histogram)}


def check_fingerprints(found: DataFrame, recorded: dict[str, str]) -> None:
    """Raise unless every recorded file name is present with its recorded hash."""
    seen = {r["name"]: r["sha256"] for r in found.select("name", "sha256").filter(F.col("name").isin(list(recorded))).collect()}
    wrong = sorted(n for n, sha in recorded.items() if seen.get(n) != sha)
    if wrong:
        raise ValueError(f"Files do not match the recorded fingerprints: {wrong}")


def require_unchanged(before: DataFrame, after: DataFrame) -> None:
    """Raise unless every file (by its whole path) still has the hash that was taken before."""
    now = after.select("path", F.col("sha256").alias("_now"))
    wrong = before.join(now, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("_now"))).orderBy("path").limit(10).collect()
    if wrong:
        raise ValueError(f"Files changed since their fingerprints were taken: {[r['path'] for r in wrong]}")


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, t in tables.items():
        t.write.mode("errorifexists").parquet(f"{path}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The stored tables, or None when there is no snapshot: nothing is invented."""
    if not _exists(spark, path):
        return None
    return {n: spark.read.parquet(f"{path}/{n}") for n in SNAPSHOT_TABLES}


def save_model(model: PipelineModel, path: str, metadata: DataFrame, sample: DataFrame, score) -> PipelineModel:
    """Save model and metadata, reload, and require equal predictions on `sample`."""
    model.write().overwrite().save(f"{path}/model")
    metadata.write.mode("overwrite").json(f"{path}/metadata")
    again = PipelineModel.load(f"{path}/model")
    before, after = score(sample, model), score(sample, again)
    if not before.exceptAll(after).isEmpty() or not after.exceptAll(before).isEmpty():
        raise ValueError("The reloaded model does not reproduce its predictions")
    return again


def load_model(spark: SparkSession, path: str, features, codes, prefix: str = "x_") -> PipelineModel:
    """Load a saved model and check its feature order, classes and probability output."""
    if not _exists(spark, f"{path}/model"):
        raise FileNotFoundError(f"No saved model at {path}")
    model = PipelineModel.load(f"{path}/model")
    assemblers = [s for s in model.stages if s.hasParam("inputCols")]
    if not assemblers or list(assemblers[0].getInputCols()) != [prefix + f for f in features]:
        raise ValueError("The saved model does not have the expected feature order")
    classifier = model.stages[-1]
    if not classifier.hasParam("probabilityCol"):
        raise ValueError("The saved model has no class probabilities")
    boosted = [s for s in model.stages if s.hasParam("probabilityCol")]
    classes = len(boosted) if len(boosted) > 1 else classifier.numClasses
    if classes != len(list(codes)):
        raise ValueError("The saved model does not have the expected classes")
    return model
