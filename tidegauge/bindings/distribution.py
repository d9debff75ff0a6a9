"""F: distribution profiles, correlation, drift and class summaries."""

from pyspark.sql import functions as F

from tidegauge.bindings.common import CLASSES, FAULT_NAMES, FEATURES, LINES_SQL, NOISY_SQL, SENSORS, SENSOR_CLASSES, lines, noisy, sensors, sensors_sql, unpivot_sql
from tidegauge.bindings.registry import query
from tidegauge.operators import distribution as G

WIDE = (2.0, 0.5)
WIDE_SQL = sensors_sql(*WIDE)
WIDE_LONG = f"long AS ({unpivot_sql(WIDE_SQL, SENSORS, 'cls, obs')})"
GROUPED = "g AS (SELECT 'all' AS grp, feature, value FROM long UNION ALL SELECT CAST(cls AS VARCHAR), feature, value FROM long)"
SUMMARY = """count(*) FILTER (isfinite(value)) AS n, count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS excluded,
  min(value) FILTER (isfinite(value)) AS min, quantile_cont(value, 0.25) FILTER (isfinite(value)) AS q1, quantile_cont(value, 0.5) FILTER (isfinite(value)) AS median,
  quantile_cont(value, 0.75) FILTER (isfinite(value)) AS q3, max(value) FILTER (isfinite(value)) AS max, avg(value) FILTER (isfinite(value)) AS mean,
  stddev_samp(value) FILTER (isfinite(value)) AS sd"""
SUMMARY_DOUBLES = "min q1 median q3 max mean sd"
UNIT_BIN = "CASE WHEN value < -1e-12 THEN -1 WHEN value > 1 + 1e-12 THEN 35 ELSE CAST(least(34, greatest(0, floor(value * 35))) AS INTEGER) END"


def wide(t):
    return sensors(t, *WIDE)


def hist_sql(where: str = "true", bins: int = 35) -> str:
    """Zero-filled unit histogram of the long table `long`."""
    return f"""SELECT f.feature, b.bin, count(l.value) AS n FROM (SELECT DISTINCT feature FROM long) f
  CROSS JOIN (SELECT CAST(unnest(range(-1, {bins + 1})) AS INTEGER) AS bin) b
  LEFT JOIN (SELECT feature, value, {UNIT_BIN} AS bin FROM long WHERE isfinite(value) AND {where}) l ON l.feature = f.feature AND l.bin = b.bin GROUP BY ALL"""


@query("f1a_feature_summary", f"WITH long AS ({unpivot_sql(NOISY_SQL, ['v', 'w'])}) SELECT 'all' AS grp, feature, {SUMMARY} FROM long GROUP BY feature", SUMMARY_DOUBLES)
def _(t):
    return G.feature_summary(noisy(t), ["v", "w"])


@query("f1b_unit_histogram", f"WITH {WIDE_LONG} SELECT 'all' AS grp, feature, bin, n FROM ({hist_sql()})")
def _(t):
    return G.unit_histogram(wide(t), SENSORS)


@query("f1c_range_histogram", f"""WITH {WIDE_LONG}, sp AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature HAVING min(value) < -1e-12 OR max(value) > 1 + 1e-12),
  e AS (SELECT feature, CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 35) AS low, CASE WHEN i = 34 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 35) END AS high FROM sp, (SELECT unnest(range(35)) AS i))
  SELECT 'all' AS grp, e.feature, e.bin, e.low, e.high, count(l.value) AS n FROM e LEFT JOIN long l
  ON l.feature = e.feature AND l.value >= e.low AND (l.value < e.high OR (e.bin = 34 AND l.value <= e.high)) GROUP BY ALL""", "low high")
def _(t):
    return G.range_histogram(wide(t), SENSORS)


def corr_sql(source: str, features, group: str) -> str:
    """Full matrix, null below 3 pairs or for a constant side."""
    parts = [f"""SELECT {group} AS grp, '{a}' AS feature_a, '{b}' AS feature_b,
  CASE WHEN count(*) FILTER (isfinite({a}) AND isfinite({b})) >= 3 AND stddev_samp({a}) FILTER (isfinite({a}) AND isfinite({b})) > 0
    AND stddev_samp({b}) FILTER (isfinite({a}) AND isfinite({b})) > 0 THEN corr({a}, {b}) FILTER (isfinite({a}) AND isfinite({b})) END AS r,
  count(*) FILTER (isfinite({a}) AND isfinite({b})) AS n FROM ({source}) GROUP BY 1""" for a in features for b in features]
    return " UNION ALL ".join(parts)


@query("f2_correlation", corr_sql(f"SELECT *, 0.25 AS flat FROM ({NOISY_SQL})", ["v", "w", "flat"], "'all'"), "r")
def _(t):
    return G.correlation_matrix(noisy(t).withColumn("flat", F.lit(0.25)), ["v", "w", "flat"])


@query("f2_correlation_by_class", corr_sql(LINES_SQL, FEATURES, "'all'") + " UNION ALL " + corr_sql(LINES_SQL, FEATURES, "CAST(cls AS VARCHAR)"), "r")
def _(t):
    return G.correlation_matrix(lines(t), FEATURES, "cls")


@query("f3_grouped_summary", f"""WITH {WIDE_LONG}, {GROUPED}, s AS (SELECT grp, feature, {SUMMARY} FROM g GROUP BY grp, feature),
  k AS (SELECT grp, feature FROM (VALUES ('all'), ('0'), ('1'), ('2'), ('3'), ('4')) AS a(grp), (SELECT DISTINCT feature FROM long))
  SELECT k.grp, k.feature, coalesce(n, 0) AS n, coalesce(excluded, 0) AS excluded, min, q1, median, q3, max, mean, sd
  FROM k LEFT JOIN s ON s.grp = k.grp AND s.feature = k.feature""", SUMMARY_DOUBLES)
def _(t):
    return G.feature_summary(wide(t), SENSORS, "cls", [0, 1, 2, 3, 4])


@query("f3_grouped_histogram", f"""WITH {WIDE_LONG}, {GROUPED}, b AS (SELECT grp, feature, {UNIT_BIN} AS bin, count(*) AS n FROM g GROUP BY ALL)
  SELECT k.grp, f.feature, i.bin, coalesce(b.n, 0) AS n FROM (VALUES ('all'), ('0'), ('1'), ('2'), ('3')) AS k(grp) CROSS JOIN (SELECT DISTINCT feature FROM long) f
  CROSS JOIN (SELECT CAST(unnest(range(-1, 36)) AS INTEGER) AS bin) i LEFT JOIN b ON b.grp = k.grp AND b.feature = f.feature AND b.bin = i.bin""")
def _(t):
    return G.unit_histogram(wide(t), SENSORS, "cls", SENSOR_CLASSES)


@query("f4_stratified_sample", f"""SELECT l_orderkey, l_partkey, cls, y FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY
  md5(k || '42'), k) AS r FROM (SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS k
  FROM ({LINES_SQL}))) WHERE r <= 333""")
def _(t):
    df = lines(t).withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return G.stratified_sample(df, "cls", "k", 3).select("l_orderkey", "l_partkey", "cls", "y")


PAIRS7 = [(a, b) for i, a in enumerate(SENSORS) for b in SENSORS[i + 1:]]
JOINT_SQL = " UNION ALL ".join(f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, cls AS class, CAST(least(19, greatest(0, floor({a} * 20))) AS INTEGER) AS i,
  CAST(least(19, greatest(0, floor({b} * 20))) AS INTEGER) AS j, count(*) AS n FROM ({WIDE_SQL}) GROUP BY ALL""" for a, b in PAIRS7)


@query("f5_joint_bins", JOINT_SQL)
def _(t):
    return G.joint_bins(wide(t), SENSORS, "cls")


ETA_SQL = """SELECT feature, CASE WHEN sum(ss) + sum(nm) > 0 AND count(*) >= 2 THEN least(1.0, greatest(0.0, sum(nm) / (sum(ss) + sum(nm)))) END AS eta_squared
  FROM (SELECT feature, var_pop(value) * count(*) AS ss, count(*) * power(avg(value) - any_value(m), 2) AS nm
  FROM (SELECT *, avg(value) OVER (PARTITION BY feature) AS m FROM long WHERE isfinite(value)) GROUP BY feature, {0}) GROUP BY feature"""


@query("f6_eta_squared", f"WITH long AS ({unpivot_sql('SELECT *, 0.5 AS flat FROM (' + LINES_SQL + ')', [*FEATURES, 'flat'], 'cls')}) {ETA_SQL.format('cls')}", "eta_squared", decimals=9)
def _(t):
    return G.eta_squared(lines(t).withColumn("flat", F.lit(0.5)), [*FEATURES, "flat"], "cls")


SPLIT = "obs % 10 < 7"
TRAIN_HIST = hist_sql("obs % 10 < 7")
TEST_HIST = hist_sql("obs % 10 >= 7")
DRIFT_SQL = f"""WITH {WIDE_LONG}, a AS (SELECT feature, min(value) AS training_min, max(value) AS training_max, median(value) AS training_median FROM long WHERE obs % 10 < 7 GROUP BY feature),
  o AS (SELECT * FROM long WHERE obs % 10 >= 7),
  b AS (SELECT feature, min(value) AS observed_min, max(value) AS observed_max, median(value) AS observed_median, count(value) AS finite_rows FROM o GROUP BY feature),
  c AS (SELECT o.feature, count(*) FILTER (value < training_min - 1e-12 OR value > training_max + 1e-12) AS outside_training_range FROM o JOIN a USING (feature) GROUP BY o.feature),
  h AS (SELECT x.feature, sum(abs(x.n / tx.n - y.n / ty.n)) / 2 AS total_variation FROM ({TRAIN_HIST}) x JOIN ({TEST_HIST}) y USING (feature, bin)
    JOIN (SELECT feature, CAST(sum(n) AS DOUBLE) AS n FROM ({TRAIN_HIST}) GROUP BY feature) tx USING (feature)
    JOIN (SELECT feature, CAST(sum(n) AS DOUBLE) AS n FROM ({TEST_HIST}) GROUP BY feature) ty USING (feature) GROUP BY x.feature)
  SELECT a.*, b.* EXCLUDE (feature), outside_training_range, total_variation, finite_rows >= 30 AND total_variation > 0.25 AS shape_review
  FROM a JOIN b USING (feature) JOIN c USING (feature) JOIN h USING (feature)"""
DRIFT_DOUBLES = "training_min training_max training_median observed_min observed_max observed_median total_variation"


def snapshot(t):
    train = wide(t).filter("obs % 10 < 7")
    return G.feature_summary(train, SENSORS), G.unit_histogram(train, SENSORS)


def observed(t):
    return wide(t).filter("obs % 10 >= 7")


@query("f7_training_comparison", DRIFT_SQL, DRIFT_DOUBLES)
def _(t):
    return G.drift(observed(t), SENSORS, *snapshot(t))


QUALITY_SQL = f"""SELECT feature, count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS excluded,
  CAST(count(*) FILTER (isfinite(value) AND (value < -1e-12 OR value > 1 + 1e-12)) AS BIGINT) AS outside FROM long GROUP BY feature"""


@query("f8_cell_quality", f"WITH long AS ({unpivot_sql(NOISY_SQL, ['v', 'w'])}) {QUALITY_SQL}")
def _(t):
    df = noisy(t)
    return G.cell_quality(G.feature_summary(df, ["v", "w"]), G.unit_histogram(df, ["v", "w"]))


@query("f10_bin_shares", f"""WITH {WIDE_LONG} SELECT feature, bin, x.n / (sum(x.n) OVER (PARTITION BY feature)) AS train_share, y.n / (sum(y.n) OVER (PARTITION BY feature)) AS observed_share
  FROM ({TRAIN_HIST}) x JOIN ({TEST_HIST}) y USING (feature, bin)""", "train_share observed_share")
def _(t):
    return G.compare_shares(snapshot(t)[1], G.unit_histogram(observed(t), SENSORS))


@query("f11_class_share", f"""SELECT k.code, count(s.cls) AS n, count(s.cls) * 100.0 / (SELECT count(*) FROM embeddings) AS percent
  FROM (VALUES (0), (1), (2), (3), (4)) AS k(code) LEFT JOIN ({WIDE_SQL}) s ON s.cls = k.code GROUP BY k.code""", "percent")
def _(t):
    return G.class_share(wide(t), "cls", [0, 1, 2, 3, 4])


def dominant_sql(source: str) -> str:
    return f"""WITH c AS (SELECT cls, count(*) AS n FROM ({source}) WHERE cls > 0 GROUP BY cls), m AS (SELECT cls FROM c WHERE n = (SELECT max(n) FROM c)),
  w AS (SELECT cls, CASE cls WHEN 1 THEN 'Motor' WHEN 2 THEN 'Inverter' ELSE 'Battery' END AS name FROM m)
  SELECT CASE WHEN count(*) = 1 THEN min(name) END AS dominant, coalesce(string_agg(name, ',' ORDER BY cls), '') AS tied, CAST(count(*) AS INTEGER) AS n_tied FROM w"""


@query("f12_dominant_abnormal", dominant_sql(WIDE_SQL))
def _(t):
    return G.dominant_abnormal(G.class_share(wide(t), "cls", SENSOR_CLASSES), FAULT_NAMES, 0)


@query("f12_tied_abnormal", dominant_sql("SELECT CAST(event_id % 4 AS INTEGER) AS cls FROM events"))
def _(t):
    df = t.events.select((F.col("event_id") % 4).cast("int").alias("cls"))
    return G.dominant_abnormal(G.class_share(df, "cls", SENSOR_CLASSES), FAULT_NAMES, 0)


@query("f13_mean_confidence", f"SELECT count(*) AS n_rows, avg(greatest(s1, s2, s3)) AS mean_confidence FROM ({sensors_sql()})", "mean_confidence")
def _(t):
    return G.mean_confidence(sensors(t).withColumn("confidence", F.greatest("s1", "s2", "s3")), "confidence")


@query("f14_first_rows", "SELECT event_id, event_type, (SELECT count(*) FROM events) AS total_rows, (SELECT count(*) FROM events) > 1000 AS truncated "
       "FROM events ORDER BY event_id LIMIT 1000")
def _(t):
    return G.first_rows(t.events.select("event_id", "event_type"), "event_id")


@query("f15_quality_warnings", f"""WITH {WIDE_LONG}, q AS (SELECT feature, count(*) FILTER (value IS NULL) AS excluded, count(*) FILTER (value < -1e-12 OR value > 1 + 1e-12) AS outside
    FROM long WHERE obs % 10 >= 7 GROUP BY feature), d AS ({DRIFT_SQL})
  SELECT feature, feature || ': ' || excluded || ' cells unavailable for charts.' AS warning FROM q WHERE excluded > 0
  UNION ALL SELECT feature, feature || ': ' || outside || ' values outside [0,1].' FROM q WHERE outside > 0
  UNION ALL SELECT feature, feature || ': ' || outside_training_range || ' outside the training range.' FROM d WHERE outside_training_range > 0
  UNION ALL SELECT feature, feature || ': distribution shape differs.' FROM d WHERE shape_review""")
def _(t):
    df = observed(t)
    quality = G.cell_quality(G.feature_summary(df, SENSORS), G.unit_histogram(df, SENSORS))
    return G.quality_warnings(quality, G.drift(df, SENSORS, *snapshot(t)))


@query("f16_cumulative_share", f"""WITH c AS (SELECT cls AS code, count(*) AS n FROM ({LINES_SQL}) GROUP BY cls)
  SELECT code, n, (sum(n) OVER (ORDER BY code) - n) * 100.0 / sum(n) OVER () AS start_percent, sum(n) OVER (ORDER BY code) * 100.0 / sum(n) OVER () AS end_percent FROM c""",
       "start_percent end_percent")
def _(t):
    return G.cumulative_share(G.class_share(lines(t), "cls", CLASSES))


@query("f17_joint_marks", f"""SELECT class, (j + 0.5) / 20 AS x, (i + 0.5) / 20 AS y, n FROM ({JOINT_SQL})
  WHERE feature_a = 's2' AND feature_b = 's5' AND (j + 0.5) / 20 BETWEEN 0.2 AND 0.8 AND (i + 0.5) / 20 BETWEEN 0.1 AND 0.9""", "x y")
def _(t):
    return G.joint_marks(G.joint_bins(wide(t), SENSORS, "cls"), "s5", "s2", (0.2, 0.8), (0.1, 0.9))
