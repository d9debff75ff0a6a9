"""Views of the given tables that the queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
CLASSES = [0, 1, 2]
CLASS_NAMES = {0: "Accepted", 1: "None", 2: "Returned"}
SENSORS = [f"s{i}" for i in range(1, 8)]
SENSOR_CLASSES = [0, 1, 2, 3]
FAULT_NAMES = {0: "Normal", 1: "Motor", 2: "Inverter", 3: "Battery"}

LINES_SQL = """SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y FROM lineitem"""


def lines(t) -> DataFrame:
    """lineitem with a 3-class target `cls` and a binary target `y`."""
    cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.lineitem.select(*FEATURES, "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             cls.alias("cls"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("y"))


def unpivot_sql(inner: str, features, keep: str = "") -> str:
    """Long form (keep, feature, value), nulls included."""
    parts = [f"SELECT {keep + ', ' if keep else ''}'{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM src" for f in features]
    return f"WITH src AS ({inner}) " + " UNION ALL ".join(parts)


LONG_SQL = unpivot_sql(LINES_SQL, FEATURES, "cls, y, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey")


def sensors(t, scale: float = 0.5, shift: float = 0.5) -> DataFrame:
    """The first 7 embedding dimensions as sensor columns s1..s7, with obs and class."""
    values = [(F.element_at("embedding", i).cast("double") * scale + shift).alias(f"s{i}") for i in range(1, 8)]
    return t.embeddings.select(F.col("vec_id").alias("obs"), (F.col("label") % 4).alias("cls"), *values)


def sensors_sql(scale: float = 0.5, shift: float = 0.5) -> str:
    values = ", ".join(f"CAST(embedding[{i}] AS DOUBLE) * {scale} + {shift} AS s{i}" for i in range(1, 8))
    return f"SELECT vec_id AS obs, CAST(label % 4 AS INTEGER) AS cls, {values} FROM embeddings"


CELLS_SQL = """SELECT event_id AS obs, event_type, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN ''
  WHEN event_id % 23 = 0 THEN 'NaN' WHEN event_id % 29 = 0 THEN 'inf' WHEN event_id % 31 = 0 THEN 'word'
  WHEN event_id % 37 = 0 THEN '1.5' WHEN event_id % 41 = 0 THEN '1d' WHEN event_id % 43 = 0 THEN ' 0.5 '
  ELSE '0.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') END AS a,
  CASE WHEN event_id % 53 = 0 THEN '-0.25' WHEN event_id % 59 = 0 THEN '  ' WHEN event_id % 61 = 0 THEN '-inf'
  ELSE '0.' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') END AS b,
  CASE WHEN event_id % 67 = 0 THEN '1.5' WHEN event_id % 71 = 0 THEN 'x' ELSE CAST(user_id % 4 AS VARCHAR) END AS label
  FROM events"""
CELLS = ["a", "b"]


def cells(t) -> DataFrame:
    """events as raw text cells with missing, non-numeric, non-finite and out-of-range defects."""
    e = F.col("event_id")
    a = (F.when(e % 17 == 0, None).when(e % 19 == 0, "").when(e % 23 == 0, "NaN").when(e % 29 == 0, "inf")
         .when(e % 31 == 0, "word").when(e % 37 == 0, "1.5").when(e % 41 == 0, "1d").when(e % 43 == 0, " 0.5 ")
         .otherwise(F.concat(F.lit("0."), F.lpad((e % 100).cast("string"), 2, "0"))))
    b = (F.when(e % 53 == 0, "-0.25").when(e % 59 == 0, "  ").when(e % 61 == 0, "-inf")
         .otherwise(F.concat(F.lit("0."), F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"))))
    label = F.when(e % 67 == 0, "1.5").when(e % 71 == 0, "x").otherwise((F.col("user_id") % 4).cast("string"))
    return t.events.select(e.alias("obs"), "event_type", a.alias("a"), b.alias("b"), label.alias("label"))


KIND_SQL = """CASE WHEN {0} IS NULL OR trim({0}) = '' THEN 'missing'
  WHEN regexp_full_match(lower(trim({0})), '[+-]?(inf|infinity)') THEN 'nonfinite'
  WHEN NOT regexp_full_match(trim({0}), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'nonnumeric'
  WHEN CAST(trim({0}) AS DOUBLE) < -1e-12 OR CAST(trim({0}) AS DOUBLE) > 1 + 1e-12 THEN 'out_of_range' ELSE 'valid' END"""
CELL_ROWS_SQL = f"""SELECT obs, event_type, feature, raw, {KIND_SQL.format('raw')} AS kind, CASE feature WHEN 'a' THEN 1 ELSE 2 END AS feature_pos
  FROM (SELECT obs, event_type, 'a' AS feature, a AS raw FROM ({CELLS_SQL}) UNION ALL SELECT obs, event_type, 'b', b FROM ({CELLS_SQL}))"""

NOISY_SQL = """SELECT event_id AS obs, ts, event_type, CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE)
  WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v,
  CAST(event_id % 7 AS DOUBLE) AS w FROM events"""


def noisy(t) -> DataFrame:
    """events with NaN, infinite and null values in `v`."""
    e = F.col("event_id")
    v = F.when(e % 11 == 0, F.lit(float("nan"))).when(e % 13 == 0, F.lit(float("inf"))).when(e % 17 == 0, None).otherwise(F.col("value"))
    return t.events.select(e.alias("obs"), "ts", "event_type", v.alias("v"), (e % 7).cast("double").alias("w"))


def repeated(t) -> DataFrame:
    """lineitem with repeated rows: lines of every fifth order a second time."""
    base = lines(t)
    return base.unionByName(base.filter(F.col("l_orderkey") % 5 == 0))


REPEATED_SQL = f"SELECT * FROM ({LINES_SQL}) UNION ALL SELECT * FROM ({LINES_SQL}) WHERE l_orderkey % 5 = 0"
