"""Data contracts. Each check returns rows (check, column, n_bad, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.expr import col, cols
from tidegauge.functions.frames import attach
from tidegauge.functions.ordering import count_descents


def _row(check: str, column: str, n: Column, detail: str = "") -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"),
                    n.cast("bigint").alias("n_bad"), F.lit(detail).alias("detail"))


def _table(df: DataFrame, rows) -> DataFrame:
    """All checks of a frame in one aggregate pass."""
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def require(violations: DataFrame) -> None:
    """Raise when any check failed; a contract has one row per check."""
    bad = violations.filter(F.col("n_bad") > 0).limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}({r['column']}): {r['n_bad']} {r['detail']}".strip() for r in bad))


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def non_empty(df: DataFrame) -> DataFrame:
    return _table(df.select(F.lit(1).alias("one")), [_row("non_empty", "*", (F.count("*") == 0).cast("int"))])


def columns_exist(df: DataFrame, columns) -> DataFrame:
    """One row per required column; n_bad is 1 when it is absent."""
    rows = [_row("exists", c, F.lit(0 if c in df.columns else 1)) for c in columns]
    return _table(df.select(F.lit(1).alias("one")), rows)


def target_classes(df: DataFrame, target: str, codes) -> DataFrame:
    """No null, and the set of values equals the codebook."""
    require_columns(df, [target])
    t, codes = col(target), list(codes)
    absent = sum((F.count_if(t == F.lit(c)) == 0).cast("int") for c in codes)
    return _table(df.select(t), [
        _row("target_null", target, F.count_if(t.isNull())),
        _row("target_unknown", target, F.count_if(~t.isin(codes))),
        _row("target_class_absent", target, absent, f"expected {codes}"),
    ])


def binary_target(df: DataFrame, target: str) -> DataFrame:
    return target_classes(df, target, [0, 1])


def valid_timestamps(df: DataFrame, column: str, order: str, tiebreak=()) -> DataFrame:
    """Datetime type, no null, no duplicate, never falling along the file order.

    With `tiebreak` columns rows may share a time, and only rows that share those as well (or lack one) are duplicates.
    """
    require_columns(df, [column, *tiebreak])
    dtype = dict(df.dtypes)[column]
    typed = dtype in ("timestamp", "timestamp_ntz", "date")
    t = col(column)
    n = df.agg(F.count("*").alias("rows"), F.count(t).alias("present"), F.count_distinct(t, *cols(tiebreak)).alias("kinds"))
    n = attach(n, count_descents(df, order, column))
    rows = [
        _row("timestamp_type", column, F.lit(0 if typed else 1), "" if typed else dtype),
        _row("timestamp_null", column, F.col("rows") - F.col("present")),
        _row("timestamp_duplicate", column, F.col("present") - F.col("kinds")),
        _row("timestamp_unsorted", column, F.col("descents")),
    ]
    return n.select(F.inline(F.array(*rows)))


def strict_frame(df: DataFrame, features, target: str | None = None, codes=(),
                 low: float = 0.0, high: float = 1.0, tol: float = X.UNIT_TOLERANCE) -> DataFrame:
    """Exact column set, non-empty, numeric, finite, in range, labels in the codebook."""
    expected = set(features) | ({target} if target else set())
    rows = [_row("schema", "*", F.lit(len(expected ^ set(df.columns)) + len(df.columns) - len(set(df.columns)))),
            _row("non_empty", "*", (F.count("*") == 0).cast("int"))]
    types = dict(df.dtypes)
    for name in [*features, *([target] if target else [])]:
        if name not in types:
            continue
        number = X.is_numeric_type(types[name])
        v = col(name).cast("double") if number else X.numeric_cell(col(name))
        rows.append(_row("numeric", name, F.lit(0 if number else 1), "" if number else types[name]))
        rows.append(_row("finite", name, F.count_if(~X.is_finite(v))))
        if name == target:
            rows.append(_row("label", name, F.count_if(X.is_finite(v) & ~v.isin([float(c) for c in codes]))))
        else:
            rows.append(_row("range", name, F.count_if(X.is_finite(v) & X.outside(v, low, high, tol))))
    return _table(df, rows)


def cell_issues(df: DataFrame, features, obs: str, keep=(), **limits) -> DataFrame:
    """Every bad cell: obs, feature, feature_pos, kind, raw text."""
    text = df.select(col(obs).alias("obs"), *cols(keep), *[col(f).cast("string").alias(f) for f in features])
    cells = text.unpivot([F.col("obs"), *cols(keep)], cols(features), "feature", "raw")
    cells = cells.withColumn("kind", X.cell_kind(F.col("raw"), **limits))
    return cells.filter(F.col("kind") != "valid").withColumn("feature_pos", X.feature_positions(features))


def first_issues(df: DataFrame, features, obs: str, n: int = 20, keep=(), **limits) -> DataFrame:
    """The first n bad cells in (feature, row) order."""
    return cell_issues(df, features, obs, keep, **limits).orderBy("feature_pos", "obs").limit(n)


def cell_counts(df: DataFrame, features, group=(), **limits) -> DataFrame:
    """feature, kind, n for every cell, valid ones included."""
    text = df.select(*cols(group), *[X.cell_kind(col(f), **limits).alias(f) for f in features])
    cells = text.unpivot(cols(group), cols(features), "feature", "kind")
    return cells.groupBy(*cols(group), "feature", "kind").agg(F.count("*").alias("n"))


def batch_verdict(df: DataFrame, features, obs: str, group=(), **limits) -> DataFrame:
    """All-or-nothing acceptance: accepted, n_bad and the first failing row and column.

    With `group` (for instance the source file) there is one verdict per group and
    a bad group does not touch the others.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), X.cell_kind(col(f), **limits).alias("kind"))
                      for i, f in enumerate(features, 1)])
    bad = F.filter(kinds, lambda k: k["kind"] != "valid")
    rows = df.select(*cols(group), col(obs).alias("obs"), bad.alias("bad"))
    first = F.min_by(F.element_at(F.col("bad"), 1), F.when(F.size("bad") > 0, F.col("obs")))
    agg = [
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.size("bad")), F.lit(0)).cast("bigint").alias("n_bad"),
        F.min(F.when(F.size("bad") > 0, F.col("obs"))).alias("first_obs"),
        F.when(F.count_if(F.size("bad") > 0) > 0, first).alias("first"),
    ]
    out = rows.groupBy(*cols(group)).agg(*agg)
    return out.select(*cols(group), "rows", ((F.col("rows") > 0) & (F.col("n_bad") == 0)).alias("accepted"), "n_bad",
                      "first_obs", F.col("first.feature").alias("first_feature"), F.col("first.kind").alias("first_kind"))


def label_check(df: DataFrame, target: str, codes) -> DataFrame:
    """code, n for every documented code, n_invalid, and whether evaluation may run."""
    v = X.numeric_cell(col(target))
    ok = F.coalesce(v.isin([float(c) for c in codes]), F.lit(False))
    counts = [F.struct(F.lit(c).alias("code"), F.count_if(v == float(c)).alias("n")) for c in codes]
    t = df.agg(F.count_if(~ok).alias("n_invalid"), F.count("*").alias("_rows"), F.array(*counts).alias("_c"))
    t = t.withColumn("evaluable", (F.col("n_invalid") == 0) & (F.col("_rows") > 0))
    return t.select("n_invalid", "evaluable", F.inline("_c"))


def compatibility(df: DataFrame, features, **limits) -> DataFrame:
    """rows, n_missing_features, n_invalid_cells, compatible."""
    present = [f for f in features if f in df.columns]
    bad = sum((F.count_if(X.cell_kind(col(f), **limits) != "valid") for f in present), F.lit(0))
    t = df.agg(F.count("*").alias("rows"), bad.cast("bigint").alias("n_invalid_cells"))
    t = t.withColumn("n_missing_features", F.lit(len(features) - len(present)))
    fine = (F.col("rows") > 0) & (F.col("n_missing_features") == 0) & (F.col("n_invalid_cells") == 0)
    return t.select("rows", "n_missing_features", "n_invalid_cells", fine.alias("compatible"))


def size_limits(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None,
                max_header: int | None = None, group=()) -> DataFrame:
    """n_bad above 0 for each exceeded limit; limits left out are not checked."""
    rows = []
    if max_rows is not None:
        rows.append(_row("max_rows", "*", F.greatest(F.count("*") - max_rows, F.lit(0))))
    if max_columns is not None:
        rows.append(_row("max_columns", "*", F.lit(max(0, len(df.columns) - max_columns))))
    if max_header is not None:
        rows.append(_row("max_header", "*", F.lit(sum(len(c) > max_header for c in df.columns))))
    t = df.groupBy(*cols(group)).agg(F.array(*rows).alias("r")) if group else df.agg(F.array(*rows).alias("r"))
    return t.select(*cols(group), F.inline("r"))


def bad_probabilities(p: str, width: int, tol: float = 1e-8, rel: float = 1e-5) -> Column:
    """Predicate: the probability array has the wrong width, a bad entry, or a sum other than 1."""
    a = col(p)
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    entries = F.forall(a, lambda v: X.is_finite(v) & (v >= 0))
    return F.coalesce(~((F.size(a) == width) & entries & (F.abs(total - 1) <= tol + rel)), F.lit(True))


def probability_check(df: DataFrame, p: str, classes, y: str | None = None, yhat: str | None = None) -> DataFrame:
    """Vector shape and sum, class order, and labels within the class list."""
    classes = list(classes)
    rows = [_row("class_order", "*", F.lit(0 if classes == sorted(set(classes)) else 1)),
            _row("probabilities", p, F.count_if(bad_probabilities(p, len(classes))))]
    for name in (y, yhat):
        if name:
            rows.append(_row("class_known", name, F.count_if(F.coalesce(~col(name).isin(classes), F.lit(True)))))
    return _table(df, rows)


def typed_record(df: DataFrame, json: str, fields: dict[str, tuple[float, float]], out: str = "problem") -> DataFrame:
    """First problem of a JSON record: not_object, fields, type, range; null when it is valid.

    Every field must be a JSON number (not text, boolean or null) inside its bounds,
    and no field may be missing or added.
    """
    v = F.try_parse_json(col(json))
    keys = F.json_object_keys(col(json))
    names = F.array_sort(F.array(*[F.lit(n) for n in fields]))
    number = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
    typed = [F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")).rlike(number), F.lit(False)) for n in fields]
    ranged = [F.coalesce(F.try_variant_get(v, f"$.{n}", "double").between(*b), F.lit(False)) for n, b in fields.items()]

    def every(tests):
        first, *rest = tests
        for t in rest:
            first = first & t
        return first

    problem = (F.when(v.isNull() | keys.isNull(), F.lit("not_object"))
               .when(F.array_sort(keys) != names, F.lit("fields"))
               .when(~every(typed), F.lit("type"))
               .when(~every(ranged), F.lit("range")))
    return df.withColumn(out, problem)


RUL_UNITS = ("operating_hours", "cycles", "seconds")


def remaining_life_check(df: DataFrame, component="component", machine="machine_id", value="estimated_rul",
                         unit="unit", version="model_version") -> DataFrame:
    """Remaining-life records: named component, machine and version, a finite value >= 0, a known unit."""

    def unnamed(c):
        return F.count_if(F.coalesce(F.length(col(c)) == 0, F.lit(True)))

    v = col(value).cast("double")
    return _table(df, [
        _row("named", component, unnamed(component)),
        _row("named", machine, unnamed(machine)),
        _row("finite_nonnegative", value, F.count_if(~(X.is_finite(v) & F.coalesce(v >= 0, F.lit(False))))),
        _row("unit", unit, F.count_if(F.coalesce(~col(unit).isin(list(RUL_UNITS)), F.lit(True)))),
        _row("named", version, unnamed(version)),
    ])


def group_labels(df: DataFrame, label: str, codes) -> DataFrame:
    """Labels must all be known before any grouped profile."""
    return _table(df.select(col(label)), [
        _row("group_label", label, F.count_if(F.coalesce(~col(label).isin(list(codes)), F.lit(True)))),
    ])
