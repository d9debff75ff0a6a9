"""What the operators share: the narrow view of a table and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker looks at together; all its temporary arrays are in proportion.
SLICE_BYTES = 1 << 19


def col(name: str) -> Column:
    """A column whose name may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id and text alone, null text as empty: no other column, whatever its name, gets into an operator."""
    return df.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), *more)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with about `limit` bytes in `column`, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Gives freed memory back, so that a reused Python worker does not hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """What is planned inside sends `rows` rows at once to a Python worker: for frames with rows of several MB, that are written inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_slices(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """`step` over slices of the frame's Arrow batches; it returns columns by name in the order of `schema`."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, column):
                out = step(piece)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)
            release()

    return df.mapInArrow(run, schema)
