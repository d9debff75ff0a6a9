"""Projections, renames, coercions and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.expr import col, cols


def normalize_names(df: DataFrame) -> DataFrame:
    """snake_case every column name."""
    return df.toDF(*[X.snake_name(n) for n in df.columns])


def check_headers(names, max_columns: int | None = None, max_length: int | None = None) -> dict[str, str]:
    """Trimmed headers; returns only the changed ones, rejects blank, repeated or oversized ones."""
    trimmed = [n.strip() for n in names]
    if max_columns is not None and len(trimmed) > max_columns:
        raise ValueError(f"{len(trimmed)} columns exceed the limit of {max_columns}")
    if max_length is not None and any(len(n) > max_length for n in trimmed):
        raise ValueError(f"A header is longer than {max_length} characters")
    if any(not n for n in trimmed):
        raise ValueError("Blank column header")
    repeated = sorted({n for n in trimmed if trimmed.count(n) > 1})
    if repeated:
        raise ValueError(f"Duplicate headers after trimming: {repeated}")
    return {a: b for a, b in zip(names, trimmed) if a != b}


def trim_names(df: DataFrame, **limits) -> DataFrame:
    check_headers(df.columns, **limits)
    return df.toDF(*[n.strip() for n in df.columns])


def allow_list(df: DataFrame, features, keep=()) -> DataFrame:
    """Exactly the approved features, in the approved order, plus `keep`."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"Missing approved features: {missing}")
    return df.select(*cols(features), *cols(keep))


def deny_list(df: DataFrame, target: str, timestamp: str | None = None, leakage=()) -> DataFrame:
    out = {target, timestamp, *leakage}
    return df.select(*cols([n for n in df.columns if n not in out]))


def features_and_target(df: DataFrame, features, target: str, keep=()) -> DataFrame:
    """Features in canonical order and the target as an int code, in one frame."""
    if target not in df.columns:
        raise ValueError(f"Missing target column: {target}")
    return allow_list(df, features, [*keep, target]).withColumn(target, col(target).cast("int"))


def rename_map(df: DataFrame, mapping: dict[str, str], features, target: str | None = None) -> DataFrame:
    """Rename source columns to canonical features after the conflict checks.

    `mapping` goes from canonical feature to source column.
    """
    unknown = [k for k in mapping if k not in features]
    if unknown:
        raise ValueError(f"Not a known feature: {unknown}")
    absent = [s for s in mapping.values() if s not in df.columns]
    if absent:
        raise ValueError(f"Mapped source columns do not exist: {absent}")
    clobbered = [k for k, s in mapping.items() if k in df.columns and s != k]
    if clobbered:
        raise ValueError(f"Mapping conflicts with existing columns: {clobbered}")
    sources = [mapping.get(f, f) for f in features]
    if len(set(sources)) != len(sources) or target in sources:
        raise ValueError("Each feature needs its own source column, and the target is never a feature")
    return df.withColumnsRenamed({s: k for k, s in mapping.items()})


def column_report(df: DataFrame, features, target: str | None = None) -> DataFrame:
    """column, status, n_present: recognized / missing / unrecognized / target."""

    def status(n: str) -> str:
        return "recognized" if n in features else "target" if n == target else "unrecognized"

    present = [F.struct(F.lit(n).alias("column"), F.lit(status(n)).alias("status"),
                        F.count(col(n)).alias("n_present")) for n in df.columns]
    absent = [F.struct(F.lit(f).alias("column"), F.lit("missing").alias("status"),
                       F.lit(0).cast("bigint").alias("n_present")) for f in features if f not in df.columns]
    return df.agg(F.array(*present, *absent).alias("r")).select(F.inline("r"))


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({n: X.numeric_cell(col(n)) for n in columns})


def infinite_to_null(df: DataFrame, columns=None) -> DataFrame:
    """NaN and infinities become null in floating-point columns; other types cannot hold them."""
    floats = [n for n, t in df.dtypes if t in ("float", "double")]
    chosen = floats if columns is None else [n for n in columns if n in floats]
    return df.withColumns({n: X.finite(col(n)) for n in chosen}) if chosen else df


def parse_timestamp(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Strict parse: a bad value fails the job."""
    if column not in df.columns:
        raise ValueError(f"there is no column {column!r} to parse as a time")
    parsed = F.to_timestamp(col(column), fmt) if fmt else F.to_timestamp(col(column))
    bad = col(column).isNotNull() & parsed.isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a time: "), col(column).cast("string"))))
    return df.withColumn(column, F.coalesce(checked.cast("timestamp"), parsed.cast("timestamp")))


def try_timestamp(c):
    return F.try_to_timestamp(c.cast("string"))


def parse_and_sort(df: DataFrame, column: str, tiebreak=()) -> DataFrame:
    """Lenient parse that counts bad values first, then orders by time; no-op if absent."""
    if column not in df.columns:
        return df
    invalid = df.filter(try_timestamp(col(column)).isNull()).count()
    if invalid:
        raise ValueError(f"{invalid} values of {column!r} cannot be read as times")
    return df.withColumn(column, try_timestamp(col(column))).orderBy(col(column), *cols(tiebreak))


def lookup_names(df: DataFrame, code: str, names: dict, out: str) -> DataFrame:
    """Code to name through a literal map."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return df.withColumn(out, F.element_at(F.create_map(*pairs), col(code)))


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*cols(X.numeric_columns(df)))


def filter_class(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.filter(col(column) == F.lit(value))


def filter_range(df: DataFrame, a: str, b: str, a_range, b_range) -> DataFrame:
    """Rows inside a rectangle of two features; bounds must be finite with min < max."""
    for low, high in (a_range, b_range):
        if not (abs(low) < X.INF and abs(high) < X.INF and low < high):
            raise ValueError("Ranges must be finite, with minimum smaller than maximum")
    return df.filter(col(a).between(*a_range) & col(b).between(*b_range))
