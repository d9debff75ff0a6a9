"""D and E: duplicates, set algebra and profiling aggregates."""

from pyspark.sql import functions as F

from tidegauge.bindings.common import (CELLS, CELL_ROWS_SQL, CELLS_SQL, FEATURES, LINES_SQL, LONG_SQL, NOISY_SQL,
                                       REPEATED_SQL, SENSORS, cells, lines, noisy, repeated, sensors, sensors_sql, unpivot_sql)
from tidegauge.bindings.registry import query
from tidegauge.operators import dedup as D
from tidegauge.operators import profile as E

STATS = "count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max"
LEVELS = ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in E.LEVELS.items())
STAT_DOUBLES = "mean sd min max q05 q25 q50 q75 q95"
LINE_COLUMNS = "l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, cls, y"
FULL_SQL = f"SELECT {LINE_COLUMNS}, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM ({LINES_SQL})"


@query("d1_drop_duplicates", f"SELECT DISTINCT * FROM ({REPEATED_SQL})", " ".join(FEATURES))
def _(t):
    return D.drop_duplicate_rows(repeated(t))


@query("d1_keep_first_by_order", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def _(t):
    return D.drop_duplicate_rows(t.events.select("user_id", "event_type", "event_id"), "event_id")


@query("d2_duplicate_rows", f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({REPEATED_SQL}))) AS duplicates FROM ({REPEATED_SQL})")
def _(t):
    return D.duplicate_count(repeated(t))


@query("d3_duplicate_feature_vectors", f"""SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax
  FROM ({LINES_SQL}))) AS duplicates FROM ({LINES_SQL})""")
def _(t):
    return D.duplicate_count(lines(t), ["l_quantity", "l_discount", "l_tax"])


@query("d4_split_equation", f"""WITH f AS (SELECT {LINE_COLUMNS} FROM ({LINES_SQL})), a AS (SELECT * FROM f WHERE l_orderkey % 5 <> 0),
  b AS (SELECT * FROM f WHERE l_orderkey % 5 = 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
  SELECT (SELECT count(*) FROM (SELECT * FROM u EXCEPT ALL SELECT * FROM f)) = 0
    AND (SELECT count(*) FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM u)) = 0 AS reconstructs,
  CAST(0 AS BIGINT) AS unequal_rows,
  (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS row_overlap,
  (SELECT count(*) FROM (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM a INTERSECT
    SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM b)) AS feature_overlap""")
def _(t):
    full = lines(t)
    test = F.col("l_orderkey") % 5 == 0
    return D.split_equation(full, full.filter(~test), full.filter(test), full.columns, FEATURES)


@query("d4_broken_split", f"""WITH f AS (SELECT {LINE_COLUMNS} FROM ({LINES_SQL})), u AS (SELECT * FROM f WHERE l_orderkey % 7 <> 0
  UNION ALL SELECT * FROM f WHERE l_orderkey % 5 = 0)
  SELECT false AS reconstructs, (SELECT count(*) FROM (SELECT DISTINCT * FROM f WHERE (l_orderkey % 7 = 0) <> (l_orderkey % 5 = 0))) AS unequal_rows,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM f WHERE l_orderkey % 7 <> 0 AND l_orderkey % 5 = 0)) AS row_overlap,
  (SELECT count(*) FROM (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM f WHERE l_orderkey % 7 <> 0 INTERSECT
    SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM f WHERE l_orderkey % 5 = 0)) AS feature_overlap""")
def _(t):
    full = lines(t)
    key = F.col("l_orderkey")
    return D.split_equation(full, full.filter(key % 7 != 0), full.filter(key % 5 == 0), full.columns, FEATURES)


@query("d5_row_overlap", f"SELECT count(*) AS n FROM (SELECT * FROM ({LINES_SQL}) WHERE l_orderkey % 3 = 0 INTERSECT SELECT * FROM ({LINES_SQL}) WHERE l_orderkey % 5 = 0)")
def _(t):
    key = F.col("l_orderkey")
    return D.row_overlap(lines(t).filter(key % 3 == 0), lines(t).filter(key % 5 == 0), lines(t).columns).agg(F.count("*").alias("n"))


@query("d6_feature_overlap", """SELECT count(*) AS n FROM (SELECT l_quantity, l_discount, l_tax FROM lineitem WHERE l_linestatus = 'F'
  INTERSECT SELECT l_quantity, l_discount, l_tax FROM lineitem WHERE l_linestatus <> 'F')""")
def _(t):
    df = lines(t)
    return D.row_overlap(df.filter("y = 1"), df.filter("y = 0"), ["l_quantity", "l_discount", "l_tax"]).agg(F.count("*").alias("n"))


@query("d7_duplicate_timestamps", "SELECT count(*) - count(DISTINCT o_orderdate) AS duplicate_timestamps FROM orders")
def _(t):
    return D.duplicate_timestamps(t.orders, "o_orderdate")


@query("d8_exclude_known", """SELECT o_orderkey, md5(CAST(o_custkey AS VARCHAR)) AS sha FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(t):
    def sha(c):
        return F.md5(F.col(c).cast("string").cast("binary")).alias("sha")

    known = t.customer.filter("c_mktsegment = 'BUILDING'").select(sha("c_custkey"))
    return D.exclude_known(t.orders.select("o_orderkey", sha("o_custkey")), known, "sha").select("o_orderkey", "sha")


@query("d8_only_known", """SELECT o_orderkey, o_custkey AS k FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(t):
    known = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return D.only_known(t.orders.select("o_orderkey", F.col("o_custkey").alias("k")), known, "k").select("o_orderkey", "k")


@query("d9_append", "SELECT c_custkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier", "bal")
def _(t):
    return D.append(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")),
                    t.supplier.select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k")))


@query("e1_overview", f"""WITH s AS ({NOISY_SQL}) SELECT 0 AS position, 'obs' AS "column", 'bigint' AS dtype, count(*) AS n_rows, count(*) - count(obs) AS n_null FROM s
  UNION ALL SELECT 1, 'ts', 'timestamp_ntz', count(*), count(*) - count(ts) FROM s
  UNION ALL SELECT 2, 'event_type', 'string', count(*), count(*) - count(event_type) FROM s
  UNION ALL SELECT 3, 'v', 'double', count(*), count(*) - count(v) FROM s
  UNION ALL SELECT 4, 'w', 'double', count(*), count(*) - count(w) FROM s""")
def _(t):
    return E.overview(noisy(t))


# Every seventh timestamp is moved back a minute, every 90th is unreadable.
SHAKY_SQL = """SELECT event_id, CASE WHEN event_id % 90 = 0 THEN 'bad' ELSE strftime(CASE WHEN event_id % 7 = 0
  THEN date_trunc('minute', ts) - INTERVAL 1 MINUTE ELSE date_trunc('minute', ts) END, '%Y-%m-%d %H:%M:%S') END AS stamp FROM events"""


@query("e2_quality_summary", f"""WITH s AS (SELECT event_id, stamp, TRY_CAST(stamp AS TIMESTAMP) AS p FROM ({SHAKY_SQL}))
  SELECT (SELECT count(*) FROM s) AS n_rows, 2 AS n_columns, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS duplicate_rows,
  (SELECT count(*) - count(p) FROM s) AS invalid_timestamps,
  (SELECT count(*) FROM s) - (SELECT count(*) FROM (SELECT DISTINCT p FROM s)) AS duplicate_timestamps,
  (SELECT count(*) = 0 FROM (SELECT p, lag(p) OVER (ORDER BY event_id) AS q FROM s) WHERE p < q) AND (SELECT count(*) = count(p) FROM s) AS timestamps_sorted""")
def _(t):
    at = F.date_trunc("minute", "ts")
    at = F.when(F.col("event_id") % 7 == 0, at - F.expr("INTERVAL 1 MINUTE")).otherwise(at)
    text = F.when(F.col("event_id") % 90 == 0, "bad").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    return E.quality_summary(t.events.select("event_id", text.alias("stamp")), "stamp", "event_id")


@query("e2_sorted_series", "SELECT count(*) AS n_rows, 2 AS n_columns, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS duplicate_rows, "
       "CAST(0 AS BIGINT) AS invalid_timestamps, count(*) - count(DISTINCT ts) AS duplicate_timestamps, true AS timestamps_sorted FROM events")
def _(t):
    return E.quality_summary(t.events.select("event_id", "ts"), "ts", "event_id")


@query("e4_value_counts", f"""SELECT k.code, count(s.cls) AS n, count(s.cls) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem) AS share
  FROM (VALUES (0), (1), (2), (3)) AS k(code) LEFT JOIN ({LINES_SQL}) s ON s.cls = k.code GROUP BY k.code""", "share")
def _(t):
    return E.value_counts(lines(t), "cls", [0, 1, 2, 3])


@query("e5_describe", f"SELECT feature, {STATS}, {LEVELS} FROM ({LONG_SQL}) GROUP BY feature", STAT_DOUBLES)
def _(t):
    return E.describe(lines(t), FEATURES)


@query("e6_column_kinds", f"""WITH s AS ({CELLS_SQL}) SELECT 'obs' AS "column", 'bigint' AS dtype, count(*) - count(obs) AS n_null, count(DISTINCT obs) AS n_distinct FROM s
  UNION ALL SELECT 'event_type', 'string', count(*) - count(event_type), count(DISTINCT event_type) FROM s
  UNION ALL SELECT 'a', 'string', count(*) - count(a), count(DISTINCT a) FROM s
  UNION ALL SELECT 'b', 'string', count(*) - count(b), count(DISTINCT b) FROM s
  UNION ALL SELECT 'label', 'string', count(*) - count(label), count(DISTINCT label) FROM s""")
def _(t):
    return E.column_kinds(cells(t))


@query("e7_blank_counts", f"""WITH s AS ({CELLS_SQL}) SELECT 'obs' AS "column", CAST(0 AS BIGINT) AS n_blank
  UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL OR trim(event_type) = '') FROM s
  UNION ALL SELECT 'a', count(*) FILTER (a IS NULL OR trim(a) = '') FROM s
  UNION ALL SELECT 'b', count(*) FILTER (b IS NULL OR trim(b) = '') FROM s
  UNION ALL SELECT 'label', count(*) FILTER (label IS NULL OR trim(label) = '') FROM s""")
def _(t):
    return E.blank_counts(cells(t))


SPLIT_SENSORS_SQL = f"SELECT *, CASE WHEN obs % 10 < 7 THEN 'train' ELSE 'test' END AS part FROM ({sensors_sql(2.0, 0.5)})"
FENCES_SQL = """fences AS (SELECT feature, quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lower,
  quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper FROM long WHERE part = 'train' GROUP BY feature)"""
LONG_SENSORS_SQL = f"long AS ({unpivot_sql(SPLIT_SENSORS_SQL, SENSORS, 'part, cls, obs')})"


def split_sensors(t):
    return sensors(t, 2.0, 0.5).withColumn("part", F.when(F.col("obs") % 10 < 7, "train").otherwise("test"))


@query("e8_audit_features", f"""WITH {LONG_SENSORS_SQL}, {FENCES_SQL}
  SELECT part, feature, {STATS}, {LEVELS}, count(*) - count(value) AS n_null, count(*) FILTER (isinf(value)) AS n_infinite,
  count(*) FILTER (value < 0 OR value > 1) AS outside_unit, count(*) FILTER (value < -1e-12 OR value > 1 + 1e-12) AS outside_unit_tolerant,
  count(*) FILTER (value < lower OR value > upper) AS iqr_flags FROM long JOIN fences USING (feature) GROUP BY part, feature""", STAT_DOUBLES)
def _(t):
    return E.audit_features(split_sensors(t), SENSORS, "part", "train")


@query("e8_audit_partitions", f"""WITH s AS (SELECT l_quantity, l_discount, l_tax, cls, part FROM ({FULL_SQL}))
  SELECT part, count(*) AS n_rows, 4 AS n_columns, count(*) - count(DISTINCT (l_quantity, l_discount, l_tax, cls)) AS duplicate_rows,
  count(*) - count(DISTINCT (l_quantity, l_discount, l_tax)) AS duplicate_feature_rows FROM s GROUP BY part""")
def _(t):
    df = lines(t).select("l_quantity", "l_discount", "l_tax", "cls", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("part"))
    return E.audit_partitions(df, ["l_quantity", "l_discount", "l_tax"], "cls", "part")


@query("e8_audit_classes", f"""SELECT part, cls AS code, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY part) AS DOUBLE) AS share
  FROM ({SPLIT_SENSORS_SQL}) GROUP BY part, cls""", "share")
def _(t):
    return E.audit_classes(split_sensors(t), "cls", "part")


@query("e9_iqr_flags", f"""WITH {LONG_SENSORS_SQL}, {FENCES_SQL} SELECT part, feature, count(*) FILTER (value < lower OR value > upper) AS n_flagged
  FROM long JOIN fences USING (feature) GROUP BY part, feature""")
def _(t):
    df = split_sensors(t)
    return E.iqr_flags(df, E.iqr_fences(df.filter("part = 'train'"), SENSORS), SENSORS, ["part"])


@query("e10_feature_statistics", f"""SELECT feature, count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind <> 'valid') AS n_invalid,
  min(CASE WHEN kind IN ('valid', 'out_of_range') THEN CAST(trim(raw) AS DOUBLE) END) AS min,
  max(CASE WHEN kind IN ('valid', 'out_of_range') THEN CAST(trim(raw) AS DOUBLE) END) AS max FROM ({CELL_ROWS_SQL}) GROUP BY feature""", "min max")
def _(t):
    return E.feature_statistics(cells(t), CELLS)


@query("e12_time_range", "SELECT min(ts) AS first, max(ts) AS last FROM events")
def _(t):
    return E.time_range(t.events, "ts")


@query("e13_target_correlations", f"""WITH s AS ({LINES_SQL}), c AS (SELECT 0.5 AS flat, * FROM s)
  SELECT 'l_quantity' AS feature, 'l_extendedprice' AS target, corr(l_quantity, l_extendedprice) AS r FROM c
  UNION ALL SELECT 'l_discount', 'l_extendedprice', corr(l_discount, l_extendedprice) FROM c
  UNION ALL SELECT 'flat', 'l_extendedprice', NULL
  UNION ALL SELECT 'l_quantity', 'y', corr(l_quantity, y) FROM c UNION ALL SELECT 'l_discount', 'y', corr(l_discount, y) FROM c
  UNION ALL SELECT 'flat', 'y', NULL""", "r")
def _(t):
    return E.target_correlations(lines(t).withColumn("flat", F.lit(0.5)), ["l_extendedprice", "y"], ["l_quantity", "l_discount", "flat"])


@query("e14_display_sample", "SELECT event_id, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '42'), event_id LIMIT 500", "value")
def _(t):
    return E.display_sample(t.events.select("event_id", "value"), "event_id", 500)


@query("e15_preview", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 5", "value")
def _(t):
    return E.preview(t.events.select("event_id", "event_type", "value"), "event_id")


@query("e16_split_boundary", """SELECT CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n_rows,
  min(ts) AS first, max(ts) AS last FROM events GROUP BY 1""")
def _(t):
    return E.split_boundary(t.events.withColumn("part", F.when(F.col("event_id") % 4 == 0, "test").otherwise("train")), "part", "ts")
