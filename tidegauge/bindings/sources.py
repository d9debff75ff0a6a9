"""A and B: sources and sinks. Each query writes table rows to the scratch folder and reads them back."""

from pyspark.sql import functions as F

from tidegauge.bindings.common import CELL_ROWS_SQL, CELLS, FAULT_NAMES, SENSOR_CLASSES, SENSORS, cells, sensors, sensors_sql
from tidegauge.bindings.distribution import (DRIFT_DOUBLES, DRIFT_SQL, GROUPED, SUMMARY, SUMMARY_DOUBLES, WIDE_LONG, observed, wide)
from tidegauge.bindings.registry import query
from tidegauge.operators import distribution as G
from tidegauge.session import scratch_dir
from tidegauge.sources import files as A
from tidegauge.sources import sinks as B

TABLE_NAMES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query("a01_list_files", "SELECT * FROM (VALUES " + ", ".join(f"('{n}.parquet', 'parquet')" for n in TABLE_NAMES) + ") AS f(name, format)")
def _(t):
    return A.list_files(t.spark, t.dir).select("name", "format")


def csv_copy(t, df, purpose, title=None, **options):
    """The rows as CSV part files, with a title line and a header of their own in each when asked."""
    path = scratch_dir(t.spark, purpose) + ".csv"
    if title is None:
        df.write.csv(path, header=True, **options)
    else:
        body = df.select(F.spark_partition_id().alias("piece"), F.lit(1).alias("o"), F.concat_ws(",", *df.columns).alias("value"))
        top = F.array(F.struct(F.lit(-1).alias("o"), F.lit(title).alias("value")), F.struct(F.lit(0).alias("o"), F.lit(",".join(df.columns)).alias("value")))
        heads = body.select("piece").distinct().select("piece", F.inline(top))
        body.unionAll(heads).repartition("piece").sortWithinPartitions("piece", "o").select("piece", "value").write.partitionBy("piece").text(path)
    return path


PARTS = "SELECT p_partkey, p_size, p_retailprice FROM part"


@query("a02_title_row", "SELECT true AS titled, false AS plain, count(*) AS n FROM part")
def _(t):
    df = t.part.select("p_partkey", "p_size", "p_retailprice")
    titled = A.has_title_row(t.spark, csv_copy(t, df, "titled", title="Spare parts"))
    plain_path = csv_copy(t, df, "plain")
    return t.spark.read.csv(plain_path, header=True).agg(
        F.lit(titled).alias("titled"), F.lit(A.has_title_row(t.spark, plain_path)).alias("plain"), F.count("*").alias("n"))


@query("a03_titled_csv", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part", "p_retailprice")
def _(t):
    return A.load_dataset(t.spark, csv_copy(t, t.part.select("p_partkey", "p_size", "p_retailprice"), "titled", title="Spare parts"))


@query("a03_csv", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_mktsegment, c_acctbal FROM customer", "c_acctbal")
def _(t):
    return A.load_dataset(t.spark, csv_copy(t, t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "customer"))


@query("a04_parquet", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return A.load_dataset(t.spark, t.path("orders")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a05_json", "SELECT s_suppkey, s_name, s_acctbal FROM supplier", "s_acctbal")
def _(t):
    path = scratch_dir(t.spark, "supplier") + ".json"
    t.supplier.select("s_suppkey", "s_name", "s_acctbal").write.json(path)
    return A.load_dataset(t.spark, path, multiLine=False)


def split_files(t):
    df = sensors(t).select(*SENSORS, "cls", "obs")
    paths = {n: scratch_dir(t.spark, n) + ".parquet" for n in ("full", "training", "testing")}
    rows = df.select(*SENSORS, "cls")
    rows.write.parquet(paths["full"])
    df.filter("obs % 10 < 7").select(*rows.columns).write.parquet(paths["training"])
    df.filter("obs % 10 >= 7").select(*rows.columns).write.parquet(paths["testing"])
    return paths


@query("a07_split_group", f"""SELECT part, cls, count(*) AS n FROM (SELECT 'full' AS part, cls FROM ({sensors_sql()}) UNION ALL
  SELECT CASE WHEN obs % 10 < 7 THEN 'training' ELSE 'testing' END, cls FROM ({sensors_sql()})) GROUP BY ALL""")
def _(t):
    return A.load_split_group(t.spark, split_files(t), SENSORS, "cls").groupBy("part", "cls").agg(F.count("*").alias("n"))


def text_files(t, df, key, header, line):
    """CSV files of each key value, header first, one for each input partition; returns the folder."""
    folder = scratch_dir(t.spark, "landing")
    rows = df.select(key.alias("source"), F.spark_partition_id().alias("piece"), F.lit(1).alias("o"), line.alias("value"))
    place = ["source", "piece"]
    header = F.lit(header) if isinstance(header, str) else header
    heads = rows.select(*place).distinct().select(*place, F.lit(0).alias("o"), header.alias("value"))
    rows.unionAll(heads).repartition(*place).sortWithinPartitions(*place, "o").select(*place, "value").write.partitionBy(*place).text(folder)
    return folder


def source_name():
    return F.regexp_extract("file", "source=([^/]+)/", 1)


KIND_COUNTS = """SELECT event_type AS source, feature, kind, count(*) AS n FROM ({0}) WHERE kind <> 'valid' AND obs % 100 <> 99 GROUP BY ALL"""


@query("a08_strict_csv_issues", KIND_COUNTS.format(CELL_ROWS_SQL) + " UNION ALL SELECT event_type, NULL, 'width', count(*) FROM events WHERE event_id % 100 = 99 GROUP BY event_type")
def _(t):
    folder = text_files(t, cells(t), F.col("event_type"), " b ,extra,a", F.when(F.col("obs") % 100 == 99, "0.5").otherwise(
        F.concat_ws(",", F.coalesce("b", F.lit("")), F.lit("note"), F.coalesce("a", F.lit("")))))
    found = A.strict_csv(t.spark, folder, CELLS).issues
    return found.groupBy(source_name().alias("source"), "feature", "kind").agg(F.count("*").alias("n"))


@query("a08_accepted_rows", f"SELECT CAST(cls AS VARCHAR) AS source, count(*) AS n, sum(round(s1 * 1000)) AS s1, sum(round(s2 * 1000)) AS s2 FROM ({sensors_sql()}) GROUP BY cls", "s1 s2")
def _(t):
    milli = [F.round(F.col(s) * 1000).cast("bigint") for s in ("s1", "s2")]
    line = F.concat_ws(",", *[F.concat(F.lit("0."), F.lpad(m.cast("string"), 3, "0")) for m in milli])
    folder = text_files(t, sensors(t), F.col("cls"), "s1,s2", line)
    rows = A.strict_csv(t.spark, folder, ["s1", "s2"]).rows
    return rows.groupBy(source_name().alias("source")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("s1") * 1000)).alias("s1"), F.sum(F.round(F.col("s2") * 1000)).alias("s2"))


@query("a09_sniff_delimiter", "SELECT * FROM (VALUES (',', 'comma'), (';', 'semicolon'), ('|', 'pipe'), (chr(9), 'tab')) AS d(delimiter, source) WHERE (SELECT count(*) FROM part) > 0")
def _(t):
    kinds = {"comma": ",", "semicolon": ";", "pipe": "|", "tab": "\t"}
    df = t.part.select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("source"), "p_partkey", "p_size", "p_retailprice")
    sep = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("source"))
    line = F.concat(F.col("p_partkey").cast("string"), sep, F.col("p_size").cast("string"), sep, F.col("p_retailprice").cast("string"))
    folder = scratch_dir(t.spark, "sniff")
    df.select("source", line.alias("value")).write.partitionBy("source").text(folder)
    return A.sniff_delimiters(t.spark, folder).select("delimiter", source_name().alias("source")).distinct()


SEPARATORS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
SEPARATOR_SQL = "CASE event_id % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END"


def quoted_files(t, value):
    """All events in files of four delimiters, with a quoted cell that holds the delimiter, doubled quotes and a line break."""
    names = F.array(*[F.lit(n) for n in SEPARATORS])
    sep = F.element_at(F.create_map(*[F.lit(x) for p in SEPARATORS.items() for x in p]), F.col("source"))
    rows = t.events.withColumn("source", F.get(names, (F.col("event_id") % 4).cast("int")))
    note = F.concat(F.lit('"said ""'), "event_type", F.lit('""'), sep, F.lit('\ntwice"'))
    return text_files(t, rows, F.col("source"), F.concat(F.lit('id'), sep, F.lit('" no\nte"'), sep, F.lit("v")), F.concat(F.col("event_id").cast("string"), sep, note, sep, value))


@query("a09_read_sniffed", f"""SELECT delimiter, CAST(event_id AS VARCHAR) AS id, 'said "' || event_type || '"' || delimiter || chr(10) || 'twice' AS note, props AS v
  FROM (SELECT *, {SEPARATOR_SQL} AS delimiter FROM events)""")
def _(t):
    found = A.read_delimited(t.spark, quoted_files(t, F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'))))
    cell = lambda name: F.get("cells", F.array_position("names", name).cast("int") - 1)
    return found.records.join(found.headers.select("file", "delimiter", "names"), "file").select("delimiter", cell("id").alias("id"), cell("no\nte").alias("note"), cell("v").alias("v"))


@query("a08_quoted_breaks", f"""SELECT delimiter AS source, count(*) AS n, sum(event_id % 1000 / 1000) AS v FROM (SELECT *, {SEPARATOR_SQL} AS delimiter FROM events) GROUP BY 1""", "v")
def _(t):
    value = F.concat(F.lit("0."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    rows = A.strict_csv(t.spark, quoted_files(t, value), ["v"], sep=None).rows
    source = F.element_at(F.create_map(*[F.lit(x) for p in SEPARATORS.items() for x in p]), source_name())
    return rows.groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("a10_chosen_table", "SELECT n_regionkey, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def _(t):
    name = "picked_" + scratch_dir(t.spark, "t").rsplit("-", 1)[-1]
    joined = t.nation.join(F.broadcast(t.nation.select("n_nationkey", "n_regionkey")), ["n_nationkey", "n_regionkey"]).join(
        t.customer, F.col("n_nationkey") == F.col("c_nationkey"))
    joined.select("n_regionkey", "c_custkey").write.option("path", scratch_dir(t.spark, "table")).saveAsTable(name)
    return A.read_table(t.spark, name).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("a11_fingerprints")
def _(t):
    return A.file_fingerprints(t.spark, t.dir + "/*.parquet").select("name", "sha256")


@query("a12_snapshot", f"WITH {WIDE_LONG}, {GROUPED} SELECT grp, feature, {SUMMARY}, true AS available, false AS invented FROM g GROUP BY grp, feature", SUMMARY_DOUBLES)
def _(t):
    path = scratch_dir(t.spark, "snapshot")
    missing = B.load_snapshot(t.spark, path)
    B.write_snapshot(B.snapshot_tables(wide(t), SENSORS, "cls", SENSOR_CLASSES), path)
    stored = B.load_snapshot(t.spark, path)
    return stored["summary"].withColumn("available", F.lit(True)).withColumn("invented", F.lit(missing is not None))


@query("a14_file_verdicts", f"""WITH k AS (SELECT event_type, obs, max(CASE WHEN kind <> 'valid' THEN feature_pos END) AS bad, min(CASE WHEN kind <> 'valid' THEN feature END) AS feature,
  min(CASE WHEN feature = 'a' AND kind <> 'valid' THEN kind END) AS ka, min(CASE WHEN feature = 'b' AND kind <> 'valid' THEN kind END) AS kb FROM ({CELL_ROWS_SQL})
  WHERE event_type <> 'view' GROUP BY ALL),
  f AS (SELECT event_type, obs, coalesce(ka, kb) AS kind, feature, row_number() OVER (PARTITION BY event_type ORDER BY obs) AS r FROM k WHERE bad IS NOT NULL)
  SELECT event_type AS source, false AS accepted, kind AS reason, (SELECT count(*) FROM events e WHERE e.event_type = f.event_type) AS n_rows,
  (SELECT count(*) + 1 FROM events e WHERE e.event_type = f.event_type AND e.event_id <= f.obs) AS first_line, feature AS first_feature FROM f WHERE r = 1
  UNION ALL SELECT 'view', true, NULL, count(*), NULL, NULL FROM events WHERE event_type = 'view'""")
def _(t):
    clean = F.when(F.col("event_type") == "view", F.lit("0.5,0.25")).otherwise(F.concat_ws(",", F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))))
    df = cells(t).orderBy("obs")
    folder = scratch_dir(t.spark, "landing")
    rows = df.select(F.col("event_type").alias("source"), F.col("obs").alias("o"), clean.alias("value"))
    heads = rows.select("source").distinct().select("source", F.lit(-1).cast("bigint").alias("o"), F.lit("a,b").alias("value"))
    rows.unionAll(heads).repartition("source").sortWithinPartitions("source", "o").select("source", "value").write.partitionBy("source").text(folder)
    return A.strict_csv(t.spark, folder, CELLS).verdict.select(source_name().alias("source"), "accepted", "reason", "n_rows", "first_line", "first_feature")


@query("b1_write_csv", "SELECT o_orderkey, o_totalprice FROM orders", "o_totalprice")
def _(t):
    path = scratch_dir(t.spark, "clean")
    B.write_table(t.orders.select("o_orderkey", "o_totalprice"), path, "csv")
    return t.spark.read.csv(path, header=True, schema="o_orderkey BIGINT, o_totalprice DOUBLE")


@query("b2_json_report", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    path = scratch_dir(t.spark, "report")
    B.write_report(t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")), path)
    return t.spark.read.json(path, schema="segment STRING, n BIGINT")


@query("b3_export_predictions", """SELECT chr(34) || CAST(event_id AS VARCHAR) || chr(34) || ',' || chr(34) || CAST(event_id % 4 AS VARCHAR) || chr(34) || ',' || chr(34) ||
  CASE event_id % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Motor' WHEN 2 THEN 'Inverter' ELSE 'Battery' END || chr(34) || ',' || chr(34) || CASE event_id % 8 WHEN 0 THEN '0.0'
  WHEN 1 THEN '0.125' WHEN 2 THEN '0.25' WHEN 3 THEN '0.375' WHEN 4 THEN '0.5' WHEN 5 THEN '0.625' WHEN 6 THEN '0.75' ELSE '0.875' END || chr(34) AS line FROM events""")
def _(t):
    e = F.col("event_id")
    name = F.element_at(F.create_map(*[F.lit(x) for p in FAULT_NAMES.items() for x in p]), (e % 4).cast("int"))
    df = t.events.select(e.alias("obs"), (e % 4).alias("code"), name.alias("name"), ((e % 8) * 0.125).cast("double").alias("confidence"))
    path = scratch_dir(t.spark, "export")
    B.export_predictions(df, path, "obs", "code", "name", "confidence")
    return t.spark.read.text(path).filter(~F.col("value").startswith('"Observation')).select(F.col("value").alias("line"))


@query("b4_export_summary", f"""WITH {WIDE_LONG}, {GROUPED} SELECT 'sensors' AS source, 'table' AS scope, 'labels' AS label_basis, '2' AS class_filter, feature, {SUMMARY}
  FROM g WHERE grp = '2' GROUP BY feature""", SUMMARY_DOUBLES)
def _(t):
    path = scratch_dir(t.spark, "summary")
    s = G.feature_summary(wide(t), SENSORS, "cls", SENSOR_CLASSES)
    B.export_summary(s, path, source="sensors", scope="table", basis="labels", group="2")
    numbers = ", ".join(f"{n} DOUBLE" for n in ("min", "q1", "median", "q3", "max", "mean", "sd"))
    return t.spark.read.csv(path, header=True, schema=f"source STRING, scope STRING, label_basis STRING, class_filter STRING, feature STRING, n BIGINT, excluded BIGINT, {numbers}")


@query("b5_export_document", f"WITH {WIDE_LONG} SELECT 'sensors' AS source, feature, count(*) FILTER (value IS NULL) AS excluded, count(*) FILTER (value < -1e-12 OR value > 1 + 1e-12) AS outside FROM long GROUP BY feature")
def _(t):
    df, path = wide(t), scratch_dir(t.spark, "document")
    summary, histogram = G.feature_summary(df, SENSORS), G.unit_histogram(df, SENSORS)
    doc = B.document({"summary": summary, "histogram": histogram, "quality": G.cell_quality(summary, histogram)}, source="sensors")
    B.write_report(doc, path)
    back = t.spark.read.schema(doc.schema).json(path)
    return back.select("source", F.inline("quality"))


@query("b7_snapshot_drift", DRIFT_SQL, DRIFT_DOUBLES)
def _(t):
    path, copy = scratch_dir(t.spark, "snapshot"), scratch_dir(t.spark, "train")
    wide(t).filter("obs % 10 < 7").write.parquet(copy)
    recorded = {r["name"]: r["sha256"] for r in A.file_fingerprints(t.spark, copy + "/*.parquet").collect()}
    B.check_fingerprints(A.file_fingerprints(t.spark, copy + "/*.parquet"), recorded)
    B.write_snapshot(B.snapshot_tables(t.spark.read.parquet(copy), SENSORS, "cls", SENSOR_CLASSES), path)
    stored = B.load_snapshot(t.spark, path)
    return G.drift(observed(t), SENSORS, stored["summary"], stored["histogram"])
