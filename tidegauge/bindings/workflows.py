"""Composite workflows over the given tables."""

from pyspark.sql import functions as F

from tidegauge.bindings import association as S
from tidegauge.bindings.common import CELLS, CELL_ROWS_SQL, CELLS_SQL, REPEATED_SQL, SENSORS, SENSOR_CLASSES, cells, repeated, sensors_sql, unpivot_sql
from tidegauge.bindings.distribution import ETA_SQL, WIDE_LONG, WIDE_SQL, wide
from tidegauge.bindings.models import tree_sql, univariate_trees_sql
from tidegauge.bindings.profile import split_sensors
from tidegauge.bindings.registry import query
from tidegauge.plans import workflows as W

SERIES = ["value", "k", "user_id"]
SERIES_NAMES = {0: "click", 1: "error", 2: "other"}
SERIES_SQL = """SELECT ts, value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, CAST(user_id AS DOUBLE) AS user_id, CAST(event_type = 'error' AS INTEGER) AS y,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS cls FROM events"""
SERIES_PART = S.chrono_sql(SERIES_SQL, "ts", "0.8")
GLONG = f"glong AS ({unpivot_sql(SERIES_PART, SERIES, 'part, cls, y')})"
BINS = f"{S.edges_cte(10)}, {S.BINNED}, {S.BINS}"


def series(t):
    kind = F.col("event_type")
    return t.events.select("ts", "event_id", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"), F.col("user_id").cast("double").alias("user_id"),
                           (kind == "error").cast("int").alias("y"), F.when(kind == "click", 0).when(kind == "error", 1).otherwise(2).alias("cls"))


@query("e03_clean", f"SELECT l_quantity, l_discount, l_orderkey, l_shipdate AS timestamp FROM (SELECT DISTINCT l_quantity, l_discount, l_orderkey, l_shipdate FROM ({REPEATED_SQL}))",
       "l_quantity l_discount")
def _(t):
    df = repeated(t).select(F.col("l_quantity").alias(" L Quantity "), "l_discount", "l_orderkey", F.col("l_shipdate").alias("Timestamp"))
    out, _ = W.clean(df, "timestamp", ["l_orderkey"])
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("e03_clean_report", f"""SELECT (SELECT count(*) FROM ({REPEATED_SQL})) AS original_rows, 11 AS original_columns, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({REPEATED_SQL}))) AS processed_rows,
  11 AS processed_columns, (SELECT count(*) FROM ({REPEATED_SQL})) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({REPEATED_SQL}))) AS duplicates_removed""")
def _(t):
    return W.clean(repeated(t), "l_shipdate")[1].drop("data_types")


@query("e11_inspection", f"""WITH c AS ({CELL_ROWS_SQL}), s AS ({CELLS_SQL}) SELECT 'invalid' AS section, feature AS item, count(*) FILTER (kind <> 'valid') AS n FROM c GROUP BY feature
  UNION ALL SELECT 'label', CAST(code AS VARCHAR), (SELECT count(*) FROM s WHERE label = CAST(code AS VARCHAR)) FROM (VALUES (0), (1), (2), (3)) AS k(code)
  UNION ALL SELECT 'duplicate', 'rows', (SELECT count(*) - count(DISTINCT (event_type, coalesce(a, '?'), b, label)) FROM s)
  UNION ALL SELECT 'duplicate', 'features', (SELECT count(*) - count(DISTINCT (coalesce(a, '?'), b)) FROM s)
  UNION ALL SELECT 'blank', 'a', count(*) FILTER (a IS NULL OR trim(a) = '') FROM s""")
def _(t):
    df = cells(t).withColumnRenamed("b", " second ")
    r = W.inspect(df, CELLS, "obs", "label", SENSOR_CLASSES, {"b": "second"})
    rows = [r["statistics"].select(F.lit("invalid").alias("section"), F.col("feature").alias("item"), F.col("n_invalid").alias("n")),
            r["labels"].select(F.lit("label"), F.col("code").cast("string"), "n"),
            r["duplicates"].select(F.lit("duplicate"), F.lit("rows"), "duplicate_rows"),
            r["duplicate_features"].select(F.lit("duplicate"), F.lit("features"), "duplicate_feature_rows"),
            r["blank"].filter("column = 'a'").select(F.lit("blank"), "column", "n_blank")]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionAll(x)
    return out


@query("f9_dashboard", f"""WITH {WIDE_LONG} SELECT 'outside' AS section, feature AS item, CAST(count(*) FILTER (value < -1e-12 OR value > 1 + 1e-12) AS DOUBLE) AS x FROM long GROUP BY feature
  UNION ALL SELECT 'eta', feature, eta_squared FROM ({ETA_SQL.format('cls')})
  UNION ALL SELECT 'class', CAST(cls AS VARCHAR), CAST(count(*) AS DOUBLE) FROM ({WIDE_SQL}) GROUP BY cls
  UNION ALL SELECT 'sample', CAST(cls AS VARCHAR), CAST(least(count(*), 250) AS DOUBLE) FROM ({WIDE_SQL}) GROUP BY cls""", "x")
def _(t):
    d = W.dashboard(wide(t), SENSORS, "obs", "cls", SENSOR_CLASSES)
    rows = [d["quality"].select(F.lit("outside").alias("section"), F.col("feature").alias("item"), F.col("outside").cast("double").alias("x")),
            d["eta_squared"].select(F.lit("eta"), "feature", "eta_squared"),
            d["classes"].select(F.lit("class"), F.col("code").cast("string"), F.col("n").cast("double")),
            d["sample"].groupBy("cls").agg(F.count("*").alias("n")).select(F.lit("sample"), F.col("cls").cast("string"), F.col("n").cast("double"))]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionAll(x)
    return out


@query("g27_binary_signal", f"""WITH {GLONG}, {BINS}, two AS ({S.TWO_SQL}) SELECT two.*, c.cohens_d, r.r, a.auc, m.mutual_information, s.train_spread, s.test_spread FROM two
  JOIN ({S.COHEN_SQL.format('SELECT * FROM two')}) c USING (feature) JOIN ({S.R_SQL}) r USING (feature) JOIN ({S.AUC_SQL}) a USING (feature)
  JOIN ({S.mi_sql('y')}) m USING (feature) JOIN ({S.SPREAD_SQL}) s USING (feature)""", S.TWO_DOUBLES + " cohens_d r auc mutual_information train_spread test_spread")
def _(t):
    return W.binary_signal(series(t), SERIES, "y", "ts", tiebreak=["event_id"])["features"]


@query("g27_binary_series", f"""WITH s AS (SELECT * FROM ({SERIES_PART}) WHERE part = 'train') SELECT lag, r, n_pairs FROM (""" + " UNION ALL ".join(
    f"SELECT {k} AS lag, corr(x, z) AS r, count(z) AS n_pairs FROM (SELECT y AS x, lag(y, {k}) OVER (ORDER BY ts) AS z FROM s)" for k in (1, 4, 96, 672)) + ")", "r")
def _(t):
    return W.binary_signal(series(t), SERIES, "y", "ts", tiebreak=["event_id"])["autocorrelation"]


@query("g28_class_signal", f"""WITH {GLONG}, {BINS}, long AS (SELECT * FROM glong WHERE part = 'train') SELECT e.feature, e.eta_squared, o.macro_auc, o.best_auc, o.best_class,
  CASE o.best_class WHEN 0 THEN 'click' WHEN 1 THEN 'error' ELSE 'other' END AS best_class_name, m.mutual_information
  FROM ({S.ETA0_SQL}) e JOIN ({S.OVR_SUMMARY_SQL}) o USING (feature) JOIN ({S.mi_sql('cls')}) m USING (feature)""", "eta_squared macro_auc best_auc mutual_information")
def _(t):
    return W.class_signal(series(t), SERIES, "cls", SERIES_NAMES, "ts", ["y", "ts"], tiebreak=["event_id"])["features"]


SIGNAL_SQL = "SELECT * FROM (" + sensors_sql(2.0, 0.5) + ") WHERE obs % 10 < 7"


@query("g29_training_signal", f"""WITH glong AS (SELECT *, 'train' AS part FROM ({unpivot_sql(SIGNAL_SQL, SENSORS, 'cls')})), long AS (SELECT * FROM glong), {S.edges_cte(10)}, {S.BINNED}
  SELECT e.feature, e.eta_squared, m.mutual_information, u.macro_f1 FROM ({S.ETA0_SQL}) e JOIN ({S.mi_sql('cls')}) m USING (feature)
  JOIN ({univariate_trees_sql(SIGNAL_SQL, SENSORS, SENSOR_CLASSES)}) u USING (feature)""", "eta_squared mutual_information macro_f1")
def _(t):
    df = split_sensors(t).filter("part = 'train'").drop("part")
    return W.training_signal(df, SENSORS, "cls", "obs", SENSOR_CLASSES, folds=5)["associations"]


@query("g29_training_rules", tree_sql(SIGNAL_SQL, SENSORS, SENSOR_CLASSES), "threshold gain")
def _(t):
    df = split_sensors(t).filter("part = 'train'").drop("part")
    return W.training_signal(df, SENSORS, "cls", "obs", SENSOR_CLASSES, folds=5)["rules"]
