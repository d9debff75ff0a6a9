"""Exact order statistics, prefix sums and row numbers without a global sort task.

Ranks are found with a pair of cells computed from the value alone:

* the outer cell is logarithmic, CELLS_PER_OCTAVE cells for each doubling, so
  any double lands in one of a few thousand cells whatever its scale;
* the inner cell divides the outer cell's own exact [min, max] into INNER parts.

Both are monotone in the value and depend only on exact aggregates, so a task
that is recomputed after an executor loss gets the same cells. Tables with one
row per cell are small, whatever the row count, and only those are windowed
over a whole key; rows are never gathered per key.

Numbers, prefix sums and neighbours come from sorted ranges with sampled bounds
over all order columns, see in_ranges().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions.expr import as_number, col, cols, order_pair
from tidegauge.session import cut_lineage

CELLS_PER_OCTAVE = 8
INNER = 16384
_SHIFT = 1100 * CELLS_PER_OCTAVE  # above the largest |log2| of a double, in cells


def outer_cell(v: Column) -> Column:
    """A null value has the lowest cell of all, as nulls sort first."""
    d = v.cast("double")
    octave = F.floor(F.log2(F.abs(d)) * CELLS_PER_OCTAVE) + _SHIFT
    beyond = F.when(F.isnan(d), F.lit(3 * _SHIFT)).when(d == float("inf"), F.lit(2 * _SHIFT)).when(d == float("-inf"), F.lit(-2 * _SHIFT))
    inside = F.when(d == 0, F.lit(0)).when(d > 0, octave).otherwise(-octave)
    cell = F.when(F.isnan(d) | (F.abs(d) == float("inf")), beyond).otherwise(inside)
    return F.coalesce(cell, F.lit(-4 * _SHIFT)).cast("int")


def same_cell(rows: DataFrame, cells: DataFrame, on, how: str = "inner") -> DataFrame:
    """Rows joined to the one cell with the same values in `on`, where null equals null."""
    named = cells.select(*[col(n).alias(f"_at_{n}") if n in on else col(n) for n in cells.columns])
    equal = reduce(lambda a, b: a & b, [col(n).eqNullSafe(col(f"_at_{n}")) for n in on])
    return rows.join(named, equal, how).drop(*[f"_at_{n}" for n in on])


def inner_cell(v: Column, low: Column, high: Column) -> Column:
    d, lo, hi = v.cast("double"), low.cast("double"), high.cast("double")
    part = F.floor(F.coalesce(F.try_divide(d - lo, hi - lo), F.lit(0.0)) * INNER)
    return F.least(F.lit(INNER - 1), part).cast("int")


def _before(measure: Column, keys, order) -> Column:
    w = W.partitionBy(*cols(keys)) if keys else W.partitionBy(F.lit(0))
    return F.coalesce(F.sum(measure).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _all(measure: Column, keys) -> Column:
    return F.sum(measure).over(W.partitionBy(*cols(keys)) if keys else W.partitionBy(F.lit(0)))


def _wanted(want: Column) -> Column:
    return F.filter(want, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))


def values_at_ranks(df: DataFrame, keys, value: str, ranks) -> DataFrame:
    """keys, _rank, _value, _total for the 0-based ranks of `value` within each key.

    `ranks` maps the per-key row count to an array of ranks. Exact for any numeric
    type. Two passes over the rows, run here, shrink the candidates to one inner cell
    per rank (about one row in 100,000 of a smooth distribution); only those are
    counted by value. A pass that would have nothing to narrow is left out.
    """
    data = df.filter(col(value).isNotNull()).select(*cols(keys), col(value).alias("_v"))
    bounds = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    solved = F.col("_lo") == F.col("_hi")

    def emit(t: DataFrame) -> DataFrame:
        return t.select(*cols(keys), F.explode("_want").alias("_rank"), F.col("_lo").alias("_value"), "_total")

    def narrowed(t: DataFrame, outer: DataFrame, within, cell: str) -> DataFrame:
        """Cells of one level that hold a wanted rank, counted on from where their outer cell starts."""
        t = same_cell(t, outer.drop("_lo", "_hi"), within)
        t = t.withColumn("_before", F.col("_base") + _before(F.col("_n"), within, [cell]))
        return t.withColumn("_want", _wanted(F.col("_want"))).filter(F.size("_want") > 0)

    data = data.withColumn("_c", outer_cell(F.col("_v")))
    t1 = data.groupBy(*cols(keys), "_c").agg(*bounds)
    t1 = t1.withColumn("_before", _before(F.col("_n"), keys, ["_c"])).withColumn("_total", _all(F.col("_n"), keys))
    # Written once, so that each later pass is exactly one scan of the rows.
    t1 = cut_lineage(t1.withColumn("_want", _wanted(ranks(F.col("_total")))).filter(F.size("_want") > 0))
    found = emit(t1.filter(solved))

    # At most len(ranks) cells per key are left, so the broadcasts do not grow with the rows.
    open1 = t1.filter(~solved).select(*cols(keys), "_c", "_lo", "_hi", F.col("_before").alias("_base"), "_total", "_want")
    low, high = open1.agg(F.min("_lo"), F.max("_hi")).first()
    if low is None:
        return found
    # Two comparisons spare most rows the search for their cell.
    x = same_cell(data.filter(F.col("_v").between(low, high)), open1.select(*cols(keys), "_c", "_lo", "_hi"), [*keys, "_c"])
    x = x.select(*cols(keys), "_c", inner_cell(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_d"), "_v")
    t2 = cut_lineage(narrowed(x.groupBy(*cols(keys), "_c", "_d").agg(*bounds), open1, [*keys, "_c"], "_d"))
    found = found.unionByName(emit(t2.filter(solved)))

    open2 = t2.filter(~solved).select(*cols(keys), "_c", "_d", "_lo", "_hi", F.col("_before").alias("_base"), "_total", "_want")
    low, high = open2.agg(F.min("_lo"), F.max("_hi")).first()
    if low is None:
        return found
    y = same_cell(x.filter(F.col("_v").between(low, high)), open2.select(*cols(keys), "_c", "_d"), [*keys, "_c", "_d"])
    t3 = y.groupBy(*cols(keys), "_c", "_d", "_v").agg(F.count("*").alias("_n"))
    t3 = narrowed(t3, open2, [*keys, "_c", "_d"], "_v").withColumn("_lo", F.col("_v"))
    return found.unionByName(emit(t3))


def quantiles(df: DataFrame, keys, value: str, probs) -> DataFrame:
    """keys, n, q: exact linear-interpolated quantiles of the non-null values, one array per key."""
    probs = [float(p) for p in probs]
    def position(p: float, total: Column) -> Column:
        return F.lit(p) * (total - 1)

    def ranks(total: Column) -> Column:
        ends = [f(position(p, total)).cast("bigint") for p in probs for f in (F.floor, F.ceil)]
        return F.array_distinct(F.array(*ends))

    found = values_at_ranks(df, keys, value, ranks)
    agg = [
        F.max("_total").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("_rank", F.col("_value").cast("double")))).alias("_at"),
    ]
    found = found.groupBy(*cols(keys)).agg(*agg) if keys else found.groupBy().agg(*agg).filter(F.col("n").isNotNull())

    def level(p: float) -> Column:
        h = position(p, F.col("n"))
        low = F.element_at("_at", F.floor(h).cast("bigint"))
        high = F.element_at("_at", F.ceil(h).cast("bigint"))
        return F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h)))

    return found.select(*cols(keys), "n", F.array(*[level(p) for p in probs]).alias("q"))


def in_ranges(df: DataFrame, order_by) -> DataFrame:
    """The rows as a written table, dealt into sorted ranges: _p numbers the ranges in order, _i the rows of a range from 0.

    The ranges' bounds are sampled over all order columns together, with a row's own place as the last one. So a run of ties, even of
    rows that are equal throughout, is spread over as many ranges as its size asks for.
    """
    by = [c if isinstance(c, Column) else col(c) for c in order_by] + [F.col("_salt")]
    rows = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
    rows = rows.withColumn("_p", F.spark_partition_id())
    return cut_lineage(rows.withColumn("_i", F.monotonically_increasing_id() - F.col("_p") * F.lit(1 << 33)))


def prefix_sums(df: DataFrame, keys, order: str, measures, descending: bool = False) -> DataFrame:
    """Adds below_<m>, the sum of m over the key's rows that come strictly earlier, and total_<m>, that over all rows of the key.

    The frame must hold one row per (key, order value); group it first. A key that holds most rows lies in many ranges, whose
    sums (one row per range and key) give each range its start.
    """
    rows = in_ranges(df, [*keys, col(order).desc() if descending else col(order)])
    starts = rows.groupBy("_p", *cols(keys)).agg(*[F.sum(col(m)).alias(f"_s_{m}") for m in measures])
    starts = starts.select("_p", *cols(keys), *[_before(F.col(f"_s_{m}"), keys, ["_p"]).alias(f"_o_{m}") for m in measures],
                           *[_all(F.col(f"_s_{m}"), keys).alias(f"total_{m}") for m in measures])
    here = ["_p", *keys]
    return same_cell(rows, starts, here).select(*cols(df.columns), *[(F.col(f"_o_{m}") + _before(col(m), here, ["_i"])).alias(f"below_{m}") for m in measures],
                                             *[f"total_{m}" for m in measures])


def number_rows(df: DataFrame, order_by, out: str = "obs") -> DataFrame:
    """1-based row numbers by `order_by`; ties are numbered in no particular order."""
    rows = in_ranges(df, [order_by] if isinstance(order_by, str) else order_by)
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", _before(F.col("_n"), [], ["_p"]).alias("_o"))
    # One row per range, so Spark sends it to the rows.
    return rows.join(sizes, "_p").select(*cols(df.columns), (F.col("_o") + F.col("_i") + 1).cast("bigint").alias(out))


def number_by_hash(df: DataFrame, keys, hashed: str, out: str, digits: int = 3) -> DataFrame:
    """1-based numbers within each key by an md5 column.

    The leading hex digits spread each key evenly over 16**digits groups, so a
    key that holds most rows is still numbered by many tasks.
    """
    data = df.withColumn("_p", F.coalesce(F.substring(col(hashed), 1, digits), F.lit("")))
    t = data.groupBy(*cols(keys), "_p").agg(F.count("*").alias("_n"))
    t = t.select(*cols(keys), "_p", _before(F.col("_n"), keys, ["_p"]).alias("_o"))
    here = F.row_number().over(W.partitionBy(*cols(keys), "_p").orderBy(col(hashed)))
    return same_cell(data, t, [*keys, "_p"]).select(*cols(df.columns), (F.col("_o") + here).cast("bigint").alias(out))


#: Rows that bracket a rank, and rows that are brought to the driver once a bracket is that small.
SAMPLED, BRACKETED = 40_000, 100_000


def _in_order(row) -> tuple:
    """Sort key of a row of numbers as Spark orders them: nulls first, NaN last."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in row)


def _compared(names, row) -> Column:
    """-1, 0 or 1 where the columns come before a row of numbers, equal it or follow it."""
    out = F.lit(0)
    for n, v in reversed(list(zip(names, row))):
        out = F.when(col(n) < F.lit(v), -1).when(col(n) > F.lit(v), 1).otherwise(out)
    return out


def numbers_at_rank(df: DataFrame, order_by, rank: int, total: int | None = None, seed: int = 7) -> tuple[tuple, int]:
    """The numbers (see as_number) of all order columns at a 0-based rank of their common order, and how many rows come strictly before them.

    A sample of bounded size puts a bracket around the rank; one aggregate over the rows counts what lies before, at and between its ends, so the
    result is exact whatever the sample. Each round leaves about a fiftieth of the rows, until they are few or the rank is in a run of ties.
    The order columns must not be null.
    """
    names = [f"_k{i}" for i in range(len(order_by))]
    rows = df.select(*[as_number(df, n).alias(k) for n, k in zip(order_by, names)])
    left, before = rows.count() if total is None else total, 0
    if not 0 <= rank < left:
        raise ValueError(f"there is no row {rank} among {left}")
    while left > BRACKETED:
        sample = sorted((tuple(r) for r in rows.sample(min(1.0, SAMPLED / left), seed).collect()), key=_in_order)
        place = (rank - before) / left * len(sample)
        slack = 4 * (place * max(0.0, 1 - (rank - before) / left)) ** 0.5 + 4
        low = sample[int(place - slack)] if place >= slack and sample else None
        high = sample[int(place + slack)] if place + slack < len(sample) else None
        to_low = _compared(names, low) if low else F.lit(1)
        to_high = _compared(names, high) if high else F.lit(-1)
        tests = [to_low < 0, to_low <= 0, to_high < 0, to_high <= 0]
        under, from_low, to, upto = rows.agg(*[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests)]).first()
        place = rank - before
        if under <= place < from_low:
            return low, before + under
        if to <= place < upto:
            return high, before + to
        # Strictly before, after or between the two, so that runs of ties drop out with each round.
        if place < under:
            rows, left = rows.filter(to_low < 0), under
        elif place >= upto:
            rows, left, before = rows.filter(to_high > 0), left - upto, before + upto
        else:
            rows, left, before = rows.filter((to_low > 0) & (to_high < 0)), to - from_low, before + from_low
        seed += 1
    few = sorted((tuple(r) for r in rows.collect()), key=_in_order)
    found = few[rank - before]
    # By sort key, as NaN is not equal to itself.
    return found, before + [_in_order(r) for r in few].index(_in_order(found))


def value_at_rank(df: DataFrame, name: str, rank: int, total: int | None = None):
    """The number (see as_number) found at a 0-based position of one sorted column."""
    return numbers_at_rank(df, [name], rank, total)[0][0]


def row_at_rank(df: DataFrame, order_by, rank: int, total: int | None = None) -> list[tuple[str, object]]:
    """(column, number) pairs that mark where the 0-based rank starts; the row before the rank must differ in some order column."""
    found, before = numbers_at_rank(df, order_by, rank, total)
    if before < rank:
        raise ValueError(f"{list(order_by)} does not identify rows uniquely at the cut; add a tie-break column")
    return list(zip(order_by, found))


def at_or_after(df: DataFrame, marks) -> Column:
    """Lexicographic predicate: the row is at or after the marked position."""
    *head, (last, value) = marks
    key, at = order_pair(df, last, value)
    test = key >= at
    for name, v in reversed(head):
        key, at = order_pair(df, name, v)
        # The wider test comes first and reaches the scan.
        test = (key >= at) & ((key > at) | test)
    return test


def count_descents(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: descents = how often `value` falls from one row to the next in `order`.

    Neighbours are compared inside sorted ranges, of which no run of ties makes one large. A range then counts as one step from
    its first to its last value.
    """
    def fold(steps: DataFrame, within, by: str) -> DataFrame:
        w = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
        steps = steps.withColumn("_before", F.lag("_last").over(w.orderBy(by)))
        falls = F.count_if(F.col("_first") < F.col("_before"))
        return steps.groupBy(*within).agg((F.coalesce(F.sum("_n"), F.lit(0)) + falls).alias("_n"), F.min_by("_first", by).alias("_first"), F.max_by("_last", by).alias("_last"))

    rows = in_ranges(df.select(col(order).alias("_o"), col(value).alias("_v")), ["_o"])
    rows = rows.select("_p", "_i", F.lit(0).alias("_n"), F.col("_v").alias("_first"), F.col("_v").alias("_last"))
    return fold(fold(rows, ["_p"], "_i"), [], "_p").select(F.coalesce("_n", F.lit(0)).cast("bigint").alias("descents"))
