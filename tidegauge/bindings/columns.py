"""P: projections, renames, coercions and row filters."""

from pyspark.sql import functions as F

from tidegauge.bindings.common import (CELLS, CELLS_SQL, CLASS_NAMES, FEATURES, LINES_SQL, NOISY_SQL, SENSORS, cells, lines,
                                       noisy, sensors, sensors_sql)
from tidegauge.bindings.registry import query
from tidegauge.functions.ordering import number_rows
from tidegauge.operators import columns as P


@query("p01_snake_case_names", "SELECT l_orderkey AS order_key, l_quantity AS l_quantity_x, l_returnflag AS return_flag FROM lineitem")
def _(t):
    return P.normalize_names(t.lineitem.select(F.col("l_orderkey").alias(" Order Key"), F.col("l_quantity").alias("  L Quantity (x) "),
                                               F.col("l_returnflag").alias("Return Flag!")))


@query("p02_trim_headers", "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer")
def _(t):
    return P.trim_names(t.customer.select(F.col("c_custkey").alias(" custkey"), F.col("c_mktsegment").alias("segment  ")))


@query("p03_allow_list", "SELECT l_tax, l_discount, l_quantity, l_extendedprice FROM lineitem")
def _(t):
    return P.allow_list(t.lineitem, ["l_tax", "l_discount", "l_quantity", "l_extendedprice"])


@query("p04_deny_list", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return P.deny_list(t.orders, "o_orderstatus", "o_orderdate", ["o_orderpriority"])


@query("p05_features_and_target", f"SELECT l_quantity, l_extendedprice, l_discount, l_tax, cls FROM ({LINES_SQL})")
def _(t):
    return P.features_and_target(lines(t).withColumn("cls", F.col("cls").cast("double")), FEATURES, "cls")


@query("p06_rename_map", "SELECT vec_id AS obs, CAST(embedding[1] AS DOUBLE) * 0.5 + 0.5 AS volt, "
       "CAST(embedding[2] AS DOUBLE) * 0.5 + 0.5 AS amp, CAST(label % 4 AS INTEGER) AS cls FROM embeddings", "volt amp")
def _(t):
    df = sensors(t).select("obs", "s1", "s2", "cls")
    return P.rename_map(df, {"volt": "s1", "amp": "s2"}, ["volt", "amp"], "cls")


@query("p07_column_report", """SELECT 'o_totalprice' AS "column", 'recognized' AS status, count(o_totalprice) AS n_present FROM orders
  UNION ALL SELECT 'o_orderstatus', 'target', count(o_orderstatus) FROM orders
  UNION ALL SELECT 'o_orderkey', 'unrecognized', count(o_orderkey) FROM orders
  UNION ALL SELECT 'o_custkey', 'unrecognized', count(o_custkey) FROM orders
  UNION ALL SELECT 'o_orderdate', 'unrecognized', count(o_orderdate) FROM orders
  UNION ALL SELECT 'o_orderpriority', 'unrecognized', count(o_orderpriority) FROM orders
  UNION ALL SELECT 'o_discount', 'missing', 0""")
def _(t):
    return P.column_report(t.orders, ["o_totalprice", "o_discount"], "o_orderstatus")


NUMBER_SQL = """CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim({0}) AS DOUBLE)
  WHEN lower(trim({0})) = 'inf' THEN CAST('Infinity' AS DOUBLE) WHEN lower(trim({0})) = '-inf' THEN CAST('-Infinity' AS DOUBLE) END"""


@query("p08_coerce_numeric", f"SELECT obs, {NUMBER_SQL.format('a')} AS a, {NUMBER_SQL.format('b')} AS b FROM ({CELLS_SQL})")
def _(t):
    return P.coerce_numeric(cells(t).select("obs", *CELLS), CELLS)


@query("p09_infinite_to_null", f"SELECT obs, CASE WHEN isfinite(v) THEN v END AS v, w FROM ({NOISY_SQL})")
def _(t):
    return P.infinite_to_null(noisy(t).select("obs", "v", "w"))


@query("p10_parse_timestamp", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders")
def _(t):
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return P.parse_timestamp(text, "at").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("p11_parse_and_sort", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def _(t):
    text = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return P.parse_and_sort(text, "at", ["event_id"]).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("p12_class_names", f"""SELECT cls, CASE cls WHEN 0 THEN 'Accepted' WHEN 1 THEN 'None' ELSE 'Returned' END AS class_name,
  count(*) AS n FROM ({LINES_SQL}) GROUP BY cls""")
def _(t):
    return P.lookup_names(lines(t), "cls", CLASS_NAMES, "class_name").groupBy("cls", "class_name").agg(F.count("*").alias("n"))


@query("p13_numeric_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(t):
    return P.numeric_only(t.customer)


@query("p14_observation_number", "SELECT event_id, row_number() OVER (ORDER BY ts) AS obs FROM events")
def _(t):
    return number_rows(t.events.select("event_id", "ts"), ["ts"]).select("event_id", "obs")


@query("p15_filter_class", f"SELECT * FROM ({sensors_sql()}) WHERE cls = 2", " ".join(SENSORS))
def _(t):
    return P.filter_class(sensors(t), "cls", 2)


@query("p16_filter_range", f"SELECT obs, cls, s1, s2 FROM ({sensors_sql()}) WHERE s1 BETWEEN 0.45 AND 0.55 AND s2 BETWEEN 0.4 AND 0.6", "s1 s2")
def _(t):
    return P.filter_range(sensors(t), "s1", "s2", (0.45, 0.55), (0.4, 0.6)).select("obs", "cls", "s1", "s2")
