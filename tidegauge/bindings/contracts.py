"""C: data contracts."""

from pyspark.sql import functions as F

from tidegauge.bindings.common import (CELLS, CELL_ROWS_SQL, CELLS_SQL, LINES_SQL, NOISY_SQL, SENSORS, cells, lines, noisy,
                                       sensors, sensors_sql)
from tidegauge.bindings.registry import query
from tidegauge.operators import contracts as C


def rows_sql(*rows, source: str) -> str:
    """UNION of (check, column, n_bad, detail) rows over one source."""
    parts = [f"""SELECT '{check}' AS "check", '{column}' AS "column", CAST({n} AS BIGINT) AS n_bad, '{detail}' AS detail FROM s"""
             for check, column, n, detail in rows]
    return f"WITH s AS ({source}) " + " UNION ALL ".join(parts)


@query("c1_non_empty", rows_sql(("non_empty", "*", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", ""), source="SELECT * FROM orders"))
def _(t):
    return C.non_empty(t.orders)


@query("c2_columns_exist", rows_sql(("exists", "o_orderkey", "min(0)", ""), ("exists", "o_missing", "min(1)", ""), source="SELECT * FROM orders"))
def _(t):
    return C.columns_exist(t.orders, ["o_orderkey", "o_missing"])


@query("c3_binary_target", rows_sql(("target_null", "y", "count(*) FILTER (y IS NULL)", ""), ("target_unknown", "y", "count(*) FILTER (y NOT IN (0, 1))", ""),
                                    ("target_class_absent", "y", "2 - count(DISTINCT CASE WHEN y IN (0, 1) THEN y END)", "expected [0, 1]"),
                                    source=LINES_SQL))
def _(t):
    return C.binary_target(lines(t), "y")


@query("c4_target_classes", rows_sql(("target_null", "cls", "count(*) FILTER (cls IS NULL)", ""),
                                     ("target_unknown", "cls", "count(*) FILTER (cls NOT IN (0, 2, 7))", ""),
                                     ("target_class_absent", "cls", "3 - count(DISTINCT CASE WHEN cls IN (0, 2, 7) THEN cls END)", "expected [0, 2, 7]"),
                                     source=f"SELECT CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE cls END AS cls FROM ({LINES_SQL})"))
def _(t):
    return C.target_classes(lines(t).withColumn("cls", F.when(F.col("l_partkey") % 9 != 0, F.col("cls"))), "cls", [0, 2, 7])


@query("c5_valid_timestamps", rows_sql(("timestamp_type", "stamp", "min(0)", ""), ("timestamp_null", "stamp", "count(*) - count(stamp)", ""),
                                       ("timestamp_duplicate", "stamp", "count(stamp) - count(DISTINCT stamp)", ""),
                                       ("timestamp_unsorted", "stamp", "count(*) FILTER (stamp < p)", ""),
                                       source="SELECT stamp, lag(stamp) OVER (ORDER BY event_id) AS p FROM (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN NULL "
                                              "WHEN event_id % 7 = 0 THEN date_trunc('hour', ts) - INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END AS stamp FROM events)"))
def _(t):
    hour = F.date_trunc("hour", "ts")
    at = F.when(F.col("event_id") % 101 == 0, None).when(F.col("event_id") % 7 == 0, hour - F.expr("INTERVAL 1 HOUR")).otherwise(hour)
    return C.valid_timestamps(t.events.select("event_id", at.alias("stamp")), "stamp", "event_id")


@query("c6_strict_frame", rows_sql(("schema", "*", "min(0)", ""), ("non_empty", "*", "min(0)", ""),
                                   ("numeric", "v", "min(0)", ""), ("finite", "v", "count(*) FILTER (v IS NULL OR NOT isfinite(v))", ""),
                                   ("range", "v", "count(*) FILTER (isfinite(v) AND (v < 0 OR v > 50))", ""),
                                   ("numeric", "w", "min(0)", ""), ("finite", "w", "count(*) FILTER (w IS NULL OR NOT isfinite(w))", ""),
                                   ("label", "w", "count(*) FILTER (w NOT IN (0, 1, 2, 3))", ""), source=NOISY_SQL))
def _(t):
    return C.strict_frame(noisy(t).select("v", "w"), ["v"], "w", [0, 1, 2, 3], low=0.0, high=50.0)


@query("c7_cell_issues", f"SELECT obs, feature, raw, kind, feature_pos FROM ({CELL_ROWS_SQL}) WHERE kind <> 'valid'")
def _(t):
    return C.cell_issues(cells(t), CELLS, "obs")


@query("c7_first_issues", f"SELECT obs, feature, raw, kind, feature_pos FROM ({CELL_ROWS_SQL}) WHERE kind <> 'valid' ORDER BY feature_pos, obs LIMIT 20")
def _(t):
    return C.first_issues(cells(t), CELLS, "obs")


@query("c7_cell_counts", f"SELECT event_type, feature, kind, count(*) AS n FROM ({CELL_ROWS_SQL}) GROUP BY ALL")
def _(t):
    return C.cell_counts(cells(t), CELLS, ["event_type"])


@query("c8_batch_verdict", f"""WITH k AS (SELECT * FROM ({CELL_ROWS_SQL})), b AS (SELECT * FROM k WHERE kind <> 'valid'),
  f AS (SELECT event_type, feature, kind, obs, row_number() OVER (PARTITION BY event_type ORDER BY obs, feature_pos) AS rn FROM b)
  SELECT k.event_type, count(*) // 2 AS rows, count(*) FILTER (k.kind <> 'valid') = 0 AS accepted, count(*) FILTER (k.kind <> 'valid') AS n_bad,
  min(f.obs) AS first_obs, min(f.feature) AS first_feature, min(f.kind) AS first_kind
  FROM k LEFT JOIN f ON f.event_type = k.event_type AND f.rn = 1 GROUP BY k.event_type""")
def _(t):
    return C.batch_verdict(cells(t), CELLS, "obs", ["event_type"])


@query("c8_accepted_batch", f"""SELECT cls, count(*) AS rows, true AS accepted, CAST(0 AS BIGINT) AS n_bad, CAST(NULL AS BIGINT) AS first_obs,
  CAST(NULL AS VARCHAR) AS first_feature, CAST(NULL AS VARCHAR) AS first_kind FROM ({sensors_sql()}) GROUP BY cls""")
def _(t):
    return C.batch_verdict(sensors(t), SENSORS, "obs", ["cls"])


@query("c9_label_check", f"""WITH s AS ({CELLS_SQL}), b AS (SELECT count(*) FILTER (label NOT IN ('0', '1', '2', '3')) AS n_invalid FROM s)
  SELECT n_invalid, n_invalid = 0 AS evaluable, code, (SELECT count(*) FROM s WHERE label = CAST(code AS VARCHAR)) AS n
  FROM b, (VALUES (0), (1), (2), (3)) AS k(code)""")
def _(t):
    return C.label_check(cells(t), "label", [0, 1, 2, 3])


@query("c10_compatibility", f"""SELECT count(*) // 2 AS rows, 1 AS n_missing_features, count(*) FILTER (kind <> 'valid') AS n_invalid_cells, false AS compatible
  FROM ({CELL_ROWS_SQL})""")
def _(t):
    return C.compatibility(cells(t), ["a", "b", "c"])


@query("c10_compatible", f"SELECT count(*) AS rows, 0 AS n_missing_features, CAST(0 AS BIGINT) AS n_invalid_cells, true AS compatible FROM ({sensors_sql()})")
def _(t):
    return C.compatibility(sensors(t), SENSORS)


@query("c11_size_limits", rows_sql(("max_rows", "*", "greatest(count(*) - 5000, 0)", ""), ("max_columns", "*", "min(2)", ""), ("max_header", "*", "min(1)", ""),
                                   source="SELECT * FROM orders"))
def _(t):
    return C.size_limits(t.orders, 5000, 4, 13)


SCORED_SQL = f"""SELECT obs, cls, [CASE WHEN obs % 50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE s1 / (s1 + s2 + s3) END, s2 / (s1 + s2 + s3),
  CASE WHEN obs % 40 = 0 THEN 0.9 ELSE s3 / (s1 + s2 + s3) END] AS p, CASE WHEN obs % 30 = 0 THEN 5 ELSE cls % 3 END AS yhat FROM ({sensors_sql()})"""


@query("c12_probability_check", rows_sql(("class_order", "*", "min(0)", ""),
                                         ("probabilities", "p", "count(*) FILTER (isnan(p[1]) OR abs(p[1] + p[2] + p[3] - 1) > 1.001e-5)", ""),
                                         ("class_known", "cls", "count(*) FILTER (cls NOT IN (0, 1, 2))", ""),
                                         ("class_known", "yhat", "count(*) FILTER (yhat NOT IN (0, 1, 2))", ""), source=SCORED_SQL))
def _(t):
    s = F.col("s1") + F.col("s2") + F.col("s3")
    o = F.col("obs")
    p = F.array(F.when(o % 50 == 0, F.lit(float("nan"))).otherwise(F.col("s1") / s), F.col("s2") / s, F.when(o % 40 == 0, 0.9).otherwise(F.col("s3") / s))
    df = sensors(t).select("cls", p.alias("p"), F.when(o % 30 == 0, 5).otherwise(F.col("cls") % 3).alias("yhat"))
    return C.probability_check(df, "p", [0, 1, 2], "cls", "yhat")


RECORD_SQL = """SELECT event_id, CASE event_id % 7 WHEN 1 THEN '{"k": "5"}' WHEN 2 THEN '{"k": 5, "z": 1}' WHEN 3 THEN '{"k": true}'
  WHEN 4 THEN '{"k": 500}' WHEN 5 THEN '[1]' WHEN 6 THEN '{}' ELSE props END AS props FROM events"""


@query("c13_typed_record", """SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'type' WHEN 2 THEN 'fields' WHEN 3 THEN 'type' WHEN 4 THEN 'range'
  WHEN 5 THEN 'not_object' WHEN 6 THEN 'fields' ELSE CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) > 60 THEN 'range' END END AS problem FROM events""")
def _(t):
    e = F.col("event_id") % 7
    text = (F.when(e == 1, '{"k": "5"}').when(e == 2, '{"k": 5, "z": 1}').when(e == 3, '{"k": true}').when(e == 4, '{"k": 500}')
            .when(e == 5, "[1]").when(e == 6, "{}").otherwise(F.col("props")))
    return C.typed_record(t.events.select("event_id", text.alias("props")), "props", {"k": (0, 60)}).select("event_id", "problem")


@query("c14_remaining_life", rows_sql(("named", "component", "count(*) FILTER (component = '')", ""), ("named", "machine_id", "count(*) FILTER (machine_id = '')", ""),
                                      ("finite_nonnegative", "estimated_rul", "count(*) FILTER (estimated_rul IS NULL OR NOT isfinite(estimated_rul) OR estimated_rul < 0)", ""),
                                      ("unit", "unit", "count(*) FILTER (unit NOT IN ('operating_hours', 'cycles', 'seconds'))", ""),
                                      ("named", "model_version", "count(*) FILTER (model_version IS NULL OR model_version = '')", ""),
                                      source=f"""SELECT event_type AS component, CASE WHEN obs % 9 = 0 THEN '' ELSE 'm' END AS machine_id,
  CASE WHEN obs % 8 = 0 THEN -v ELSE v END AS estimated_rul, CASE WHEN obs % 6 = 0 THEN 'days' ELSE 'cycles' END AS unit,
  CASE WHEN obs % 5 = 0 THEN NULL ELSE 'v1' END AS model_version FROM ({NOISY_SQL})"""))
def _(t):
    o = F.col("obs")
    df = noisy(t).select(F.col("event_type").alias("component"), F.when(o % 9 == 0, "").otherwise("m").alias("machine_id"),
                         F.when(o % 8 == 0, -F.col("v")).otherwise(F.col("v")).alias("estimated_rul"),
                         F.when(o % 6 == 0, "days").otherwise("cycles").alias("unit"), F.when(o % 5 != 0, "v1").alias("model_version"))
    return C.remaining_life_check(df)


@query("c15_group_labels", rows_sql(("group_label", "label", "count(*) FILTER (label IS NULL OR label NOT IN ('0', '1', '2', '3'))", ""), source=CELLS_SQL))
def _(t):
    return C.group_labels(cells(t), "label", ["0", "1", "2", "3"])
