"""Small literal frames and zero-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.expr import col, cols


def grid(spark: SparkSession, **axes) -> DataFrame:
    """Cross product of literal lists; a value list per column name."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row, as a scalar subquery instead of a join."""
    value = one_row.select(F.struct(*cols(one_row.columns)).alias("_v")).scalar()
    return df.select("*", *[value.getField(c).alias(c) for c in one_row.columns])


def zero_fill(counts: DataFrame, frame: DataFrame, keys, measures) -> DataFrame:
    """Every key combination of a literal frame, with 0 where there was no row."""
    joined = frame.join(counts, list(keys), "left")
    return joined.select(*cols(keys), *[F.coalesce(col(m), F.lit(0)).cast(dict(counts.dtypes)[m]).alias(m) for m in measures])


def with_groups(df: DataFrame, label: str, out: str = "grp") -> DataFrame:
    """Each row once for `all` and once for its class; unlabelled rows count in `all` only."""
    both = F.array(F.lit("all"), col(label).cast("string"))
    return df.withColumn(out, F.explode(F.filter(both, lambda g: g.isNotNull())))
