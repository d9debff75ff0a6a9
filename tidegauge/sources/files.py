"""File discovery, CSV / Parquet / JSON scans, and the strict CSV reader."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.expr import col, cols
from tidegauge.operators.columns import check_headers
from tidegauge.operators.dedup import require_split
from tidegauge.session import cut_lineage
from tidegauge.sources.digests import file_sha256
from tidegauge.sources.records import by_delimiter, read_records, sniff_delimiters

FORMATS = ("csv", "parquet", "json")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, format, n_bytes of the datasets in a folder, sorted; contents are not read.

    A dataset is a file, or a folder of part files as Spark writes them, with a known extension. Other folders are not looked into.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.split_part(F.substr("path", F.lit(len(root) + 2)), F.lit("/"), F.lit(1))
    files = files.groupBy(name.alias("name")).agg(F.sum("length").alias("n_bytes"))
    found = files.withColumn("format", F.substring_index("name", ".", -1)).filter(F.contains("name", F.lit(".")) & F.col("format").isin(*FORMATS))
    return found.select(F.concat(F.lit(root + "/"), "name").alias("path"), "name", "format", "n_bytes").orderBy("path")


def file_fingerprints(spark: SparkSession, paths) -> DataFrame:
    """path, name, sha256 of the file bytes, as the files are at the time of the call."""
    return file_sha256(spark, paths).select("path", F.substring_index("path", "/", -1).alias("name"), "sha256")


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """file, line, text for every physical line, numbered from 1 within its file.

    Lines get their place inside a file block while it is scanned; the block
    counts (one row per block) give each block's first number. Nothing is sorted.
    """
    text = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    blocks = text.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("file", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    # One row per file block (128 MB by default), so the broadcast is about a millionth of the text.
    line = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return text.join(F.broadcast(blocks), ["file", "_start"]).select("file", line.alias("line"), "text")


def head_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first n non-empty lines of one file."""
    text = spark.read.text(path).filter((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
    return [r["value"].removeprefix("﻿").strip("\r") for r in text.select("value").take(n)]


def has_title_row(spark: SparkSession, path: str) -> bool:
    """Whether the first non-empty line has fewer commas than the second."""
    lines = head_lines(spark, path, 2)
    return len(lines) == 2 and lines[0].strip().count(",") < lines[1].strip().count(",")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    return sniff_delimiters(spark, path).first()["delimiter"]


def infer_types(df: DataFrame, order=("bigint", "double", "timestamp")) -> DataFrame:
    """Text columns cast to the narrowest type that fits every cell; one aggregate pass."""
    def misfit(n: str, t: str) -> Column:
        return F.count_if((F.trim(col(n)) != "") & F.trim(col(n)).try_cast(t).isNull())

    tests = df.agg(*[misfit(n, t).alias(f"{i}_{t}") for i, n in enumerate(df.columns) for t in order]).first()
    out = []
    for i, n in enumerate(df.columns):
        fit = next((t for t in order if tests[f"{i}_{t}"] == 0), None)
        out.append(F.when(F.trim(col(n)) != "", F.trim(col(n)).try_cast(fit)).alias(n) if fit else col(n))
    return df.select(*out)


#: A title and a header are looked for among so many first lines.
HEAD_LINES = 1000


def _titled_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records below the title and the header, the first two non-empty lines of every file; a record is one line.

    All files have the same header, among their first HEAD_LINES lines. A file with fewer than two non-empty lines has no records.
    """
    lines = numbered_lines(spark, [path]).filter(F.trim("text") != "")
    place = F.row_number().over(W.partitionBy("file").orderBy("line"))
    heads = numbered_lines(spark, [path]).filter((F.col("line") <= HEAD_LINES) & (F.trim("text") != "")).withColumn("_place", place)
    heads = heads.filter("_place = 2").select("file", F.col("line").alias("head_line"), F.rtrim(F.col("text"), F.lit("\r")).alias("header"))
    header = heads.agg(F.min("header").alias("first"), F.max("header").alias("last")).first()
    if header["first"] is None:
        raise ValueError(f"There is no header among the first {HEAD_LINES} lines of {path}")
    if header["first"] != header["last"]:
        raise ValueError(f"Files of one dataset have different headers: {header['first']!r} and {header['last']!r}")
    sep = options.pop("sep", ",")
    names = [n.strip() for n in next(csv.reader([header["first"]], delimiter=sep))]
    check_headers(names)
    schema = ", ".join(f"c{i} STRING" for i in range(len(names)))
    record = F.from_csv(F.rtrim(F.col("text"), F.lit("\r")), schema, {"sep": sep, **{k: str(v) for k, v in options.items()}})
    # One row per file, fewer than the file blocks that number the lines.
    placed = lines.join(F.broadcast(heads.select("file", "head_line")), "file", "left")
    no_header = F.raise_error(F.concat(F.lit(f"There is no header among the first {HEAD_LINES} lines of "), F.col("file"))).cast("boolean")
    below = F.when(F.col("head_line").isNotNull(), F.col("line") > F.col("head_line")).when(F.col("line") > HEAD_LINES, no_header).otherwise(False)
    rows = placed.filter(below).select(record.alias("r")).select("r.*")
    return infer_types(rows.toDF(*names))


def load_dataset(spark: SparkSession, path: str, **options) -> DataFrame:
    """Scan by extension: .csv (a title line above the header is skipped), .parquet or .json with one object per line."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix == "csv":
        if has_title_row(spark, path):
            return _titled_csv(spark, path, **options)
        return spark.read.csv(path, **{"header": True, "inferSchema": "schema" not in options, **options})
    if suffix == "parquet":
        return spark.read.parquet(path, **options)
    if suffix == "json":
        return spark.read.json(path, **options)
    raise ValueError(f"Unsupported dataset format: .{suffix}")


def load_split_group(spark: SparkSession, paths: dict[str, str], features, target: str,
                     full: str = "full", train: str = "training", test: str = "testing") -> DataFrame:
    """The named datasets in one frame with a `part` column, after the split has been verified."""
    columns = [*features, target]
    frames = {n: load_dataset(spark, p).select(*cols(columns)) for n, p in paths.items()}
    require_split(frames[full], frames[train], frames[test], columns, features)
    out = None
    for n, f in frames.items():
        part = f.withColumn("part", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def _field_pattern(sep: str) -> tuple[str, str]:
    s = "\\" + sep if sep == "|" else sep
    return s, rf'"(?:[^"]++|"")*+"|[^{s}]*+'


def csv_cells(text: Column, sep: Column | str = ",") -> Column:
    """Cells of one CSV record of any width: unquoted, doubled quotes undone, empty cells kept. The delimiter may differ by row."""
    def found(d: str) -> Column:
        s, field = _field_pattern(d)
        return F.regexp_extract_all(F.concat(F.lit(d), text), F.lit(f"{s}({field})"), F.lit(1))

    def bare(c: Column) -> Column:
        inner = F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        return F.when(c.startswith('"') & (F.length(c) > 1), inner).otherwise(c)

    return F.transform(by_delimiter(sep, found), bare)


def well_quoted(text: Column, sep: str = ",") -> Column:
    """Every cell of a one-line record is either free of a leading quote or quoted to its end."""
    s, _ = _field_pattern(sep)
    cell = rf'(?:"(?:[^"]++|"")*+"|(?:[^"{s}][^{s}]*+)?)'
    return text.rlike(rf"^{cell}(?:{s}{cell})*+$")


@dataclass
class DelimitedFiles:
    """Tables of one delimited read: header and delimiter per file, cells per record with its line, and what is wrong with which line."""

    headers: DataFrame
    records: DataFrame
    issues: DataFrame


def read_delimited(spark: SparkSession, paths, sep: str | None = None) -> DelimitedFiles:
    """Files of any header and width, each read with the delimiter that its first lines show, or with `sep`.

    `headers`: file, delimiter, names (trimmed), width. `records`: file, line (the record's last), cells, as many as the header has names.
    `issues`: file, line, kind, feature-free, of records that are not UTF-8, have broken quoting or another width. A blank line is a record of
    another width, as in the strict reader. Files without a line are left out.
    """
    records = cut_lineage(read_records(spark, paths, sep))
    cells = csv_cells(F.col("text"), F.col("delimiter") if sep is None else sep)
    headers = records.filter("first_line = 1").select("file", "delimiter", F.transform(cells, lambda c: F.trim(c)).alias("names"))
    headers = headers.withColumn("width", F.size("names"))
    body = records.filter("first_line > 1").withColumn("cells", cells).join(F.broadcast(headers.select("file", "width")), "file")
    kind = F.when(~F.col("utf8"), F.lit("invalid_utf8")).when(F.col("broken"), F.lit("bad_quote")).when((F.col("text") == "") | (F.size("cells") != F.col("width")), F.lit("width"))
    body = body.withColumn("kind", kind)
    first = records.filter("first_line = 1 AND (broken OR NOT utf8)").select("file", "line", F.when(F.col("broken"), F.lit("bad_quote")).otherwise(F.lit("invalid_utf8")).alias("kind"))
    return DelimitedFiles(headers, body.filter("kind IS NULL").select("file", "line", "cells"), body.filter("kind IS NOT NULL").select("file", "line", "kind").unionAll(first))


def load_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """One table of text columns from files with the same header, whatever the delimiter of each; a wrong record fails the load and names its line."""
    found = read_delimited(spark, path, sep)
    heads = found.headers.agg(F.min("names").alias("first"), F.max("names").alias("last"), F.min("file").alias("file")).first()
    if heads["first"] is None:
        raise ValueError(f"There is no line in {path}")
    if heads["first"] != heads["last"]:
        raise ValueError(f"Files of one dataset have different headers: {heads['first']} and {heads['last']}")
    check_headers(heads["first"])
    wrong = found.issues.agg(F.min(F.struct("file", "line", "kind")).alias("w")).first()["w"]
    if wrong is not None:
        raise ValueError(f"Line {wrong['line']} of {wrong['file']}: {wrong['kind']}")
    return found.records.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(heads["first"])])


#: All that can be wrong with a record or a cell.
KINDS = ("invalid_utf8", "bad_quote", "width", "missing", "nonnumeric", "nonfinite", "out_of_range")


@dataclass
class StrictFiles:
    """Tables of one strict read: verdict per file, issues per line and cell, accepted rows."""

    verdict: DataFrame
    issues: DataFrame
    rows: DataFrame


def strict_csv(spark: SparkSession, paths, features, sep: str | None = ",", low: float = 0.0, high: float = 1.0,
               max_columns: int | None = None, max_header: int | None = None, max_rows: int | None = None) -> StrictFiles:
    """Read sensor columns from CSV files, each file accepted or rejected as a whole.

    Headers are trimmed and located by name in each file, so column order and extra
    columns do not matter. A quoted cell may hold line breaks; a record's line is its
    last one. Without `sep` each file has the delimiter that its first lines show. A file
    is rejected for a blank, repeated, missing or oversized header, for invalid UTF-8,
    broken quoting, a record of the wrong width (a blank line included), and for any
    cell that is not a finite number in range. One bad file leaves the others untouched.
    """
    features = list(features)
    # Validity is read off the raw bytes: any string function would already have replaced bad ones.
    # Written once, so that records of several lines are put together once for the verdict, the issues and the rows.
    lines = cut_lineage(read_records(spark, paths, sep))
    heads = lines.filter("first_line = 1")
    cells = csv_cells(F.col("text"), F.col("delimiter") if sep is None else sep)

    names = F.transform(cells, lambda c: F.trim(c))
    header = heads.select("file", "broken", names.alias("names"), cells.alias("original"))
    spots = F.array(*[F.array_position("names", f) for f in features])
    counted = F.size(F.array_distinct("names"))
    absent = F.array(*[F.when(~F.array_contains("names", f), F.lit(f)) for f in features])
    oversize = F.lit(False)
    if max_columns is not None:
        oversize = oversize | (F.size("names") > max_columns)
    if max_header is not None:
        oversize = oversize | F.exists("names", lambda n: F.length(n) > max_header)
    header = header.select(
        "file", "names", F.size("names").alias("_width"), spots.alias("_spots"),
        F.when(F.col("broken"), F.lit("bad_quote")).when(oversize, F.lit("header_limit")).when(F.exists("names", lambda n: n == ""), F.lit("blank_header"))
        .when(counted < F.size("names"), F.lit("duplicate_header"))
        .when(F.size(F.filter(absent, lambda a: a.isNotNull())) > 0, F.lit("missing_feature")).alias("header_problem"),
        F.filter(absent, lambda a: a.isNotNull()).alias("missing_features"),
        F.array_except("names", F.array(*[F.lit(f) for f in features])).alias("ignored_columns"),
        F.filter(F.transform(F.arrays_zip("original", "names"), lambda z: F.when(z["original"] != z["names"], z["original"])),
                 lambda n: n.isNotNull()).alias("trimmed_headers"))

    # One short row per file, as in the list of files that the driver holds anyway; the lines stay where they were read.
    body = lines.filter("first_line > 1").join(F.broadcast(header.select("file", "_width", "_spots")), "file")
    # The one-element explode keeps the optimizer from repeating the parse for every use of a cell.
    body = body.withColumn("_cells", F.explode(F.array(cells)))
    values = [F.when(F.col("_spots")[i] > 0, F.get(F.col("_cells"), (F.col("_spots")[i] - 1).cast("int"))).alias(f)
              for i, f in enumerate(features)]
    shape = (F.when(~F.col("utf8"), F.lit("invalid_utf8")).when(F.col("broken"), F.lit("bad_quote"))
             .when((F.col("text") == "") | (F.size("_cells") != F.col("_width")), F.lit("width")))
    body = body.select("file", "line", shape.alias("_shape"), *values)
    kinds = F.array(*[F.struct(F.lit(f).alias("feature"), X.cell_kind(col(f), low, high).alias("kind")) for f in features])
    problems = (F.when(F.col("_shape").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("feature"), F.col("_shape").alias("kind"))))
                .otherwise(F.filter(kinds, lambda k: k["kind"] != "valid")))
    body = body.withColumn("_problems", problems)

    # The first problem as one number (line, kind, feature), so that no task sorts its lines to find it.
    kind_of, feature_of = F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.lit(f) for f in features], F.lit(None).cast("string"))
    base, first = len(features) + 1, F.element_at("_problems", 1)
    place = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in features]), first["feature"]) - 1, F.lit(len(features)))
    code = (F.col("line") * len(KINDS) + F.array_position(kind_of, first["kind"]) - 1) * base + place
    per_file = body.groupBy("file").agg(F.count("*").alias("n_rows"), F.min(F.when(F.size("_problems") > 0, code)).alias("_code"))
    whole, at = F.expr(f"_code div {base}"), F.col("_code") % base
    per_file = per_file.select("file", "n_rows", F.when(F.col("_code").isNotNull(), F.struct(
        F.expr(f"_code div {base * len(KINDS)}").alias("line"),
        F.struct(F.get(feature_of, at.cast("int")).alias("feature"), F.get(kind_of, (whole % len(KINDS)).cast("int")).alias("kind")).alias("p"))).alias("_first"))
    n = F.coalesce("n_rows", F.lit(0)).cast("bigint")
    over = (n > max_rows) if max_rows is not None else F.lit(False)
    reason = (F.when(F.col("header_problem").isNotNull(), F.col("header_problem")).when(n == 0, F.lit("no_rows"))
              .when(over, F.lit("row_limit")).otherwise(F.col("_first.p.kind")))
    verdict = header.join(per_file, "file", "left").select(
        "file", reason.isNull().alias("accepted"), reason.alias("reason"), n.alias("n_rows"),
        F.when(F.col("header_problem").isNull(), F.col("_first.line")).alias("first_line"),
        F.when(F.col("header_problem").isNull(), F.col("_first.p.feature")).alias("first_feature"),
        "missing_features", "ignored_columns", "trimmed_headers")
    issues = body.select("file", "line", F.inline("_problems"))
    good = verdict.filter("accepted").select("file")
    rows = body.join(F.broadcast(good), "file", "left_semi").select("file", "line", *[X.numeric_cell(col(f)).alias(f) for f in features])
    return StrictFiles(verdict, issues, rows)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Ordinary tables only; views and temporary views are left out."""
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return sorted(t.name for t in found if not t.isTemporary and (t.tableType or "").upper() in ("MANAGED", "EXTERNAL"))


def read_table(spark: SparkSession, name: str | None, database: str | None = None) -> DataFrame:
    """One explicitly chosen ordinary table."""
    tables = list_tables(spark, database)
    if name not in tables:
        raise ValueError(f"Choose one of the ordinary tables: {tables}")
    return spark.table(f"`{database}`.`{name}`" if database else f"`{name}`")
