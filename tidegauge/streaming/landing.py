"""Score text files as they land: bad rows to a quarantine table, good ones to predictions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidegauge.functions import expr as X
from tidegauge.functions.expr import col, cols
from tidegauge.operators.scoring import prediction_records, score_batch
from tidegauge.sources.files import csv_cells, well_quoted


def _records(batch: DataFrame, fields, features) -> DataFrame:
    """The batch's lines below each file's header with their columns found by name, and the problems of each line."""
    batch = batch.withColumn("_utf8", F.is_valid_utf8("value")).withColumn("_id", F.monotonically_increasing_id())
    batch = batch.withColumn("line", F.regexp_replace("value", "\r$", "")).drop("value").filter(F.trim("line") != "")
    top = batch.filter("_start = 0").groupBy("_file").agg(F.min("_id").alias("_head"), F.min_by("line", "_id").alias("_top"))
    names = F.transform(csv_cells(F.regexp_replace("_top", "^﻿", "")), lambda c: F.trim(c))
    # One header per file. No hint: Spark broadcasts it when small, and otherwise splits a file that holds most lines.
    rows = batch.join(top.select("_file", "_head", names.alias("_names")), "_file", "left")
    rows = rows.filter(F.col("_head").isNull() | (F.col("_id") != F.col("_head")))
    # The one-element explode keeps the optimizer from repeating the parse for every use of a cell.
    rows = rows.withColumn("_cells", F.explode(F.array(csv_cells(F.col("line")))))

    def cell(name: str):
        spot = F.array_position("_names", F.lit(name))
        found = F.when(spot > 0, F.get(F.col("_cells"), (spot - 1).cast("int")))
        return F.when(found != "", found)

    absent = F.exists(F.array(*[F.lit(f.name) for f in fields]), lambda n: ~F.array_contains(F.col("_names"), n))
    shape = (F.when(F.col("_names").isNull(), F.lit("missing_header"))
             .when(F.size(F.array_distinct("_names")) < F.size("_names"), F.lit("duplicate_header")).when(absent, F.lit("missing_column"))
             .when(~F.col("_utf8"), F.lit("invalid_utf8")).when(~well_quoted(F.col("line")), F.lit("bad_quote"))
             .when(F.size("_cells") != F.size("_names"), F.lit("width")))
    values = [(cell(f.name) if f.name in features else cell(f.name).try_cast(f.dataType)).alias(f.name) for f in fields]
    rows = rows.select(*values, "source_file", "line", shape.alias("_shape"))
    kinds = F.array(*[F.struct(F.lit(f).alias("feature"), X.cell_kind(col(f)).alias("kind")) for f in features])
    whole = F.array(F.struct(F.lit(None).cast("string").alias("feature"), F.col("_shape").alias("kind")))
    problems = F.when(F.col("_shape").isNotNull(), whole).otherwise(F.filter(kinds, lambda k: k["kind"] != "valid"))
    return rows.withColumn("problems", problems).drop("_shape")


def land(spark: SparkSession, folder: str, schema: str, model: PipelineModel, features, names: dict, version: str,
         predictions: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """One run over the files that are new since the last run, then stop.

    Columns are found by name in each file's own header, so their order and further columns do not matter. A line
    of another width than its header, with broken quoting or invalid UTF-8, or below a header that lacks or
    repeats a column goes to quarantine with its text, like a line with an unusable cell. Blank lines are skipped.
    The file source remembers finished files in `checkpoint`. Each batch writes its
    own batch_id partition in overwrite mode, so a batch repeated after a failure
    replaces its first attempt instead of doubling it.
    """
    features, fields = list(features), StructType.fromDDL(schema).fields
    passing = [*[f.name for f in fields if f.name not in features], "source_file"]
    text = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("source_file"),
                                                F.col("_metadata.file_block_start").alias("_start"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _records(batch, fields, features).persist()
        try:
            rows.filter(F.size("problems") > 0).write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
            good = rows.filter(F.size("problems") == 0).select(*cols(passing), *[X.numeric_cell(col(f)).alias(f) for f in features])
            scored = score_batch(good, model, features, names, passing, strict=False)
            prediction_records(scored, names, version).write.mode("overwrite").parquet(f"{predictions}/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return text.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
