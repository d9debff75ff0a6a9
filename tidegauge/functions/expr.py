"""Column expressions shared by all operators. Everything stays JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
UNIT_TOLERANCE = 1e-12
NUMERIC_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
INFINITE_TEXT = r"^[+-]?(inf|infinity)$"
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def col(name: str) -> Column:
    """Column by literal name; dots, spaces and brackets in names are safe."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names) -> list[Column]:
    return [col(n) for n in names]


def snake_name(name: str) -> str:
    return re.sub(r"[^a-z0-9_]", "", name.strip().lower().replace(" ", "_"))


def is_numeric_type(dtype: str) -> bool:
    return dtype.split("(")[0] in NUMERIC_TYPES


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if is_numeric_type(t)]


def is_finite(c: Column) -> Column:
    """True only for a present, non-NaN, non-infinite value (never null)."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(INF)), F.lit(False))


def finite(c: Column) -> Column:
    return F.when(is_finite(c), c)


def ratio(a: Column, b: Column) -> Column:
    """Quotient, null on a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    """Quotient, zero on a zero divisor."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def numeric_cell(c: Column) -> Column:
    """Text cell to double; null unless the trimmed text is a plain number or an infinity."""
    text = F.trim(c.cast("string"))
    return (
        F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))
        .when(F.lower(text).rlike(INFINITE_TEXT), F.when(text.startswith("-"), F.lit(-INF)).otherwise(F.lit(INF)))
    )


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def cell_kind(c: Column, low: float = 0.0, high: float = 1.0, tol: float = UNIT_TOLERANCE) -> Column:
    """missing > nonnumeric > nonfinite > out_of_range > valid."""
    v = numeric_cell(c)
    return (
        F.when(blank(c), F.lit("missing"))
        .when(v.isNull(), F.lit("nonnumeric"))
        .when(~is_finite(v), F.lit("nonfinite"))
        .when((v < low - tol) | (v > high + tol), F.lit("out_of_range"))
        .otherwise(F.lit("valid"))
    )


def outside(c: Column, low: float = 0.0, high: float = 1.0, tol: float = UNIT_TOLERANCE) -> Column:
    return (c < low - tol) | (c > high + tol)


def hash_order(key: Column, seed) -> Column:
    """Seeded pseudo-random order key, identical on every engine that has md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))).cast("binary"))


def pearson(a: Column, b: Column, min_pairs: int = 2) -> Column:
    """Pairwise-complete correlation; null below min_pairs or for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return F.when(F.count_if(both) >= min_pairs, r)


def as_number(df: DataFrame, name: str) -> Column:
    """Order-preserving numeric form of a numeric, date or timestamp column."""
    dtype = dict(df.dtypes)[name]
    if is_numeric_type(dtype):
        return col(name)
    if dtype in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(col(name).cast("timestamp"))
    if dtype == "date":
        return F.unix_date(col(name))
    raise TypeError(f"Order column {name!r} must be numeric, date or timestamp, not {dtype}")


def order_pair(df: DataFrame, name: str, value) -> tuple[Column, Column]:
    """The column and a literal of its own type for a number found by as_number, so that comparisons reach the scan."""
    dtype = dict(df.dtypes)[name]
    if dtype in ("timestamp", "timestamp_ntz"):
        return col(name), F.timestamp_micros(F.lit(value).cast("bigint")).cast(dtype)
    if dtype == "date":
        return col(name), F.date_from_unix_date(F.lit(value).cast("int"))
    return as_number(df, name), F.lit(value)


def to_long(df: DataFrame, features, keep=(), value: str = "value") -> DataFrame:
    """One row per (row, feature); only the named columns survive, so scans stay pruned."""
    wide = df.select(*cols(keep), *[col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(cols(keep), cols(features), "feature", value)


def feature_positions(features) -> Column:
    """Position of the `feature` column in the given order, as an expression."""
    return F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int")
