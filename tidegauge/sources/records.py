"""Records of delimited text files, with quoted line breaks, from files that are read in blocks.

Whether a line break ends a record depends on all quotes before it. So every line is a map from the state before it (between records, or inside a
quoted cell) to the state after it. Within a block the maps are composed while it is scanned, for both states in which the block may
begin; the blocks' own maps, one row each, are composed by file, which gives every block its real first state. Only lines of records that
span several lines are brought together; all other lines are records where they stand.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage

DELIMITERS = (",", ";", "\t", "|")
SNIFF_BYTES = 8192
#: Characters of a record that spans several lines; a longer one counts as a quote that was never closed.
LONGEST_RECORD = 131_072


def blocks_of_text(spark: SparkSession, paths) -> DataFrame:
    """file, start (of the block), text of every line, in the order of the scan, and whether the block is only a part of its file."""
    cut = F.col("_metadata.file_block_length") < F.col("_metadata.file_size")
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"), cut.alias("cut"))


def runs(batch: pa.RecordBatch, names=("file", "start")) -> list[tuple[int, int]]:
    """First and last row (exclusive) of each run of rows with the same values."""
    change = np.zeros(batch.num_rows, bool)
    for n in names:
        code = batch.column(n).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change[1:] |= code[1:] != code[:-1]
    edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a]


def sniffed(sample: str, whole: bool) -> str:
    """The delimiter that gives all records of a sample the same width above one, else a comma. Of several the first of DELIMITERS counts."""
    for delimiter in DELIMITERS:
        try:
            widths = [len(r) for r in csv.reader(io.StringIO(sample, newline=""), delimiter=delimiter) if r]
        except csv.Error:
            continue
        # What the sample cuts off may be half a record, but it is not judged alone.
        if not whole and len(widths) > 1:
            widths.pop()
        if len(set(widths)) == 1 and widths[0] > 1:
            return delimiter
    return ","


def sniff_delimiters(spark: SparkSession, paths) -> DataFrame:
    """file, delimiter. Only the first block's lines are looked at, and of them the first 8 KiB of whole lines, one line at least.

    Files without a line are left out.
    """

    def run(batches):
        file, held, size, whole, full = None, [], 0, True, False
        for batch in batches:
            for a, b in runs(batch, ("file",)):
                if (name := batch.column("file")[a].as_py()) != file:
                    if held:
                        yield answer(file, held, whole)
                    file, held, size, whole, full = name, [], 0, not batch.column("cut")[a].as_py(), False
                while a < b and not full:
                    line = batch.column("text")[a].cast(pa.binary()).as_py()
                    size, a = size + len(line) + 1, a + 1
                    full = size > SNIFF_BYTES and bool(held)
                    if not full:
                        held.append(line)
                whole = whole and not full
        if held:
            yield answer(file, held, whole)

    def answer(file, held, whole):
        sample = b"\n".join(held).decode("utf-8", "replace").removeprefix("﻿")
        return pa.RecordBatch.from_pydict({"file": [file], "delimiter": [sniffed(sample, whole)]})

    return blocks_of_text(spark, paths).filter("start = 0").mapInArrow(run, "file string, delimiter string")


def _escaped(sep: str) -> str:
    return "\\" + sep if sep in "|^]\\.$*+?()[{" else sep


def by_delimiter(sep: Column | str, made, choices=DELIMITERS) -> Column:
    """`made(delimiter)` for the delimiter that a row's file has."""
    if isinstance(sep, str):
        return made(sep)
    out = F.when(F.lit(False), made(choices[0]))
    for d in choices:
        out = out.when(sep == d, made(d))
    return out


def line_map(text: Column, sep: Column | str) -> tuple[Column, Column]:
    """The state after a line (0 between records, 1 inside a quoted cell, 2 broken quoting) if it begins between records, or inside a cell.

    A quote opens a cell only at its start, is doubled inside, and closes a cell only at its end.
    """
    inside = '(?:[^"]++|"")*+'

    def after(d: str) -> tuple[Column, Column]:
        s = _escaped(d)
        cell = rf'(?:"{inside}"|[^"{s}][^{s}]*+)?+'
        start = F.when(text.rlike(rf"^{cell}(?:{s}{cell})*+$"), 0).when(text.rlike(rf'^(?:{cell}{s})*+"{inside}$'), 1).otherwise(2)
        again = F.when(text.rlike(rf"^{inside}$"), 1).when(text.rlike(rf'^{inside}"(?:{s}{cell})*+$'), 0)
        return start, again.when(text.rlike(rf'^{inside}"(?:{s}{cell}(?={s}))*+{s}"{inside}$'), 1).otherwise(2)

    plain = ~F.contains(text, F.lit('"'))
    return F.when(plain, 0).otherwise(by_delimiter(sep, lambda d: after(d)[0])), F.when(plain, 1).otherwise(by_delimiter(sep, lambda d: after(d)[1]))


def composed(start: np.ndarray, again: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each line of a run that is entered in state `first`. Broken lines end between records.

    Each map is constant, keeps the state or swaps it; so the state is that after the last constant one, swapped as often as a swap followed.
    """
    start, again = start == 1, again == 1
    constant, swap = start == again, start & ~again
    swaps = np.cumsum(swap) & 1
    last = np.maximum.accumulate(np.where(constant, np.arange(len(start)), -1))
    after = np.where(last >= 0, start[last] ^ swaps ^ swaps[last], first ^ swaps).astype(np.int8)
    return np.append(np.int8(first), after[:-1]), after


SCANNED = "file string, start bigint, n bigint, text string, utf8 boolean, delimiter string, " + ", ".join(
    f"before{e} tinyint, after{e} tinyint, broken{e} boolean, begun{e} bigint" for e in (0, 1))


def scanned(lines: DataFrame, sep: Column | str) -> DataFrame:
    """Every line with its number in the block (from 1) and, for both states that the block may begin in: the states before and after the line, whether
    its quoting is broken, and the number of the line that began its record (0: before the block)."""
    start, again = line_map(F.col("text"), sep)

    def run(batches):
        block, n, state, begun = None, 0, [0, 1], [0, 0]
        for batch in batches:
            for a, b in runs(batch):
                piece = batch.slice(a, b - a)
                if (key := (piece.column("file")[0].as_py(), piece.column("start")[0].as_py())) != block:
                    block, n, state, begun = key, 0, [0, 1], [0, 0]
                number = np.arange(n + 1, n + 1 + b - a)
                out = {"file": piece.column("file"), "start": piece.column("start"), "n": number} | {k: piece.column(k) for k in ("text", "utf8", "delimiter")}
                maps = [piece.column(k).to_numpy(zero_copy_only=False) for k in ("from0", "from1")]
                for e in (0, 1):
                    before, after = composed(maps[0], maps[1], state[e])
                    since = np.maximum(np.maximum.accumulate(np.where(before == 0, number, 0)), begun[e])
                    broken = np.where(before == 0, maps[0], maps[1]) == 2
                    out |= {f"before{e}": before, f"after{e}": after, f"broken{e}": broken, f"begun{e}": since}
                    state[e], begun[e] = int(after[-1]), int(since[-1])
                n += b - a
                yield pa.RecordBatch.from_pydict(out)

    given = lines.select("file", "start", "text", "delimiter", F.is_valid_utf8("text").alias("utf8"), start.cast("tinyint").alias("from0"), again.cast("tinyint").alias("from1"))
    return given.mapInArrow(run, SCANNED)


def entered(blocks: DataFrame) -> DataFrame:
    """file, start, entry (the state in which each block begins), offset (lines before it), carried (line that began the record open at its start)."""
    order = W.partitionBy("file").orderBy("start")
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("to0") > F.col("to1")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("lines").over(ahead), F.lit(0))).withColumn("swaps", swaps)
    fixed = F.when(F.col("to0") == F.col("to1"), (F.col("to0") + F.col("swaps")) % 2)
    blocks = blocks.withColumn("entry", ((F.coalesce(F.last(fixed, True).over(ahead), F.lit(0)) + F.coalesce(F.last("swaps").over(ahead), F.lit(0))) % 2).cast("int"))
    begun = F.when(F.col("entry") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    carried = F.last(F.when(begun > 0, begun + F.col("offset")), True).over(ahead)
    return blocks.select("file", "start", "entry", "offset", carried.alias("carried"))


def numbered(spark: SparkSession, paths, sep: str | None = ",") -> DataFrame:
    """file, line (from 1), text, utf8, delimiter, and of each line: inside (begins in a quoted cell), open (ends in one), broken, begun (line that began
    its record). Without `sep` each file has the delimiter that its first lines show."""
    lines = blocks_of_text(spark, paths)
    # One row per file here and one per file block below, about a millionth of the text; the lines stay where they were read.
    lines = lines.join(F.broadcast(sniff_delimiters(spark, paths)), "file") if sep is None else lines.withColumn("delimiter", F.lit(sep))
    # Written once: the blocks' maps and all readers of the lines need it.
    found = cut_lineage(scanned(lines, F.col("delimiter") if sep is None else sep))
    blocks = found.groupBy("file", "start").agg(F.max("n").alias("lines"), *[F.max_by(f"after{e}", "n").cast("int").alias(f"to{e}") for e in (0, 1)],
                                                *[F.max(f"begun{e}").alias(f"begun{e}") for e in (0, 1)])
    placed = found.join(F.broadcast(cut_lineage(entered(blocks))), ["file", "start"])
    pick = lambda name: F.when(F.col("entry") == 0, F.col(name + "0")).otherwise(F.col(name + "1"))
    begun = F.when(pick("begun") > 0, pick("begun") + F.col("offset")).otherwise(F.col("carried"))
    return placed.select("file", (F.col("offset") + F.col("n")).alias("line"), "text", "utf8", "delimiter", (pick("before") == 1).alias("inside"),
                         (pick("after") == 1).alias("open"), pick("broken").alias("broken"), begun.alias("begun"))


def read_records(spark: SparkSession, paths, sep: str | None = ",", longest: int = LONGEST_RECORD) -> DataFrame:
    """file, line, first_line, text, delimiter, utf8, broken of every record of delimited files.

    A record may span lines where a quoted cell holds line breaks, which become "\\n"; `line` is the record's last line and `first_line` its first.
    The byte-order mark and a carriage return before a line's end are left out. `broken` marks records with misplaced quotes and those
    whose quote is never closed; so does a record of several lines with more than `longest` characters, whose text is null. After a broken line
    a new record begins.
    """
    lines = numbered(spark, paths, sep).withColumn("text", F.regexp_replace("text", "\r$", ""))
    lines = lines.withColumn("text", F.when(F.col("line") == 1, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text")))
    alone = lines.filter("NOT inside AND NOT open").select("file", "line", F.col("line").alias("first_line"), "text", "delimiter", "utf8", "broken")
    parts = lines.filter("inside OR open").withColumn("size", F.length("text") + 1)
    # The delimiter is that of the file; as a key it leaves only numbers to add up, so nothing is sorted for it.
    sizes = parts.groupBy("file", "begun", "delimiter").agg(F.sum("size").alias("total"), F.max("line").alias("line"), F.min("utf8").alias("utf8"), F.max("broken").alias("broken"),
                                               F.max_by("open", "line").alias("unclosed"))
    # Only records of bounded size are put together.
    short = parts.join(sizes.filter(F.col("total") <= longest).select("file", "begun"), ["file", "begun"], "left_semi")
    whole = short.groupBy("file", "begun").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    several = sizes.join(whole.select("file", "begun", text.alias("text")), ["file", "begun"], "left")
    return alone.unionByName(several.select("file", "line", F.col("begun").alias("first_line"), "text", "delimiter", "utf8",
                                            (F.col("broken") | F.col("unclosed") | F.col("text").isNull()).alias("broken")))
