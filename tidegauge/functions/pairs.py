"""Sums over all unordered pairs of features without a row per pair.

Each task adds up small dense tables, one entry per pair (and bin), for the groups that it meets, and hands them on when its rows end or the tables
have reached a bounded size. Only these partial sums are shuffled.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.expr import col

#: Numbers that a task's tables hold before they are handed on.
HELD = 1 << 23


def _grouped_rows(batch: pa.RecordBatch, name: str):
    """(group, its rows) for each group of a batch; a null group is one too."""
    coded = batch.column(name).dictionary_encode()
    codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    values = [*coded.dictionary.to_pylist(), None]
    edges = np.searchsorted(codes[order], np.arange(len(values) + 1))
    return [(v, order[a:b]) for v, a, b in zip(values, edges[:-1], edges[1:]) if b > a]


def _numbers(batch: pa.RecordBatch, features: int) -> np.ndarray:
    """Rows by features as doubles, NaN where null."""
    return np.stack([batch.column(f"_{i}").cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(features)], axis=1)


def _name(features, index: str) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in features]), F.col(index) + 1)


def pair_counts(df: DataFrame, features, group: str, bins: int, measure: str | None = None) -> DataFrame:
    """feature_a, feature_b, group, a, b, n and total: rows and the sum of `measure` in every occupied pair of bins.

    The feature columns hold bin numbers below `bins`; a row counts for a pair when both are not null, and so is the measure, if there is one.
    """
    features, pairs = list(features), list(combinations(range(len(features)), 2))
    cells = bins * bins
    kind = df.schema[group].dataType.simpleString()

    def handed_on(tables: dict, given: pa.DataType) -> pa.RecordBatch:
        out = {k: [] for k in ("ia", "ib", "g", "a", "b", "n", "total")}
        for g, (n, total) in tables.items():
            pair, cell = np.nonzero(n)
            first, second = np.array(pairs)[pair].T if len(pair) else (pair, pair)
            for key, value in zip(out, (first, second, [g] * len(pair), cell // bins, cell % bins, n[pair, cell], total[pair, cell])):
                out[key].append(value)
        groups = pa.array([x for part in out.pop("g") for x in part], given)
        whole = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
        types = {"ia": pa.int32(), "ib": pa.int32(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64(), "total": pa.float64()}
        arrays = {k: pa.array(v.astype(types[k].to_pandas_dtype()), types[k]) for k, v in whole.items()} | {"g": groups}
        return pa.RecordBatch.from_pydict({k: arrays[k] for k in ("ia", "ib", "g", "a", "b", "n", "total")})

    def run(batches):
        tables: dict = {}
        given = None
        for batch in batches:
            given = batch.schema.field("_g").type
            values = _numbers(batch, len(features))
            weight = batch.column("_y").to_numpy(zero_copy_only=False) if measure else np.ones(len(values))
            for g, rows in _grouped_rows(batch, "_g"):
                x, y = values[rows], weight[rows]
                use = ~np.isnan(x) & ~np.isnan(y)[:, None]
                code = np.where(use, x, 0).astype(np.int64)
                n, total = tables.setdefault(g, (np.zeros((len(pairs), cells), np.int64), np.zeros((len(pairs), cells))))
                for p, (i, j) in enumerate(pairs):
                    both = use[:, i] & use[:, j]
                    cell = (code[:, i] * bins + code[:, j])[both]
                    n[p] += np.bincount(cell, minlength=cells)
                    if measure:
                        total[p] += np.bincount(cell, y[both], cells)
            if len(tables) * 2 * len(pairs) * cells > HELD:
                yield handed_on(tables, given)
                tables = {}
        if tables and pairs:
            yield handed_on(tables, given)

    narrow = df.select(col(group).alias("_g"), *[col(f).cast("int").alias(f"_{i}") for i, f in enumerate(features)], *([col(measure).cast("double").alias("_y")] if measure else []))
    parts = narrow.mapInArrow(run, f"ia int, ib int, g {kind}, a int, b int, n bigint, total double")
    whole = parts.groupBy("ia", "ib", "g", "a", "b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return whole.select(_name(features, "ia").alias("feature_a"), _name(features, "ib").alias("feature_b"), F.col("g").alias(group), "a", "b", "n", "total")


MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")
ENDS = ("lox", "loy", "hix", "hiy")


def pair_moments(df: DataFrame, features, group: str) -> DataFrame:
    """ia, ib (ia <= ib), group, and over the rows where both features are finite: n, the sums and products of both (sx ... sxy) and their ends (lox ... hiy).

    Products of large numbers that differ little lose digits, so shift the features near their means first.
    """
    k = len(features)
    above = np.triu_indices(k)

    def moments(x: np.ndarray) -> dict[str, np.ndarray]:
        has = np.isfinite(x)
        v, m = np.where(has, x, 0.0), has.astype(float)
        low, high = np.where(has, x, np.inf), np.where(has, x, -np.inf)
        s, q = v.T @ m, (v * v).T @ m  # of the first feature, over the rows of the second
        lo = np.stack([np.where(has[:, j : j + 1], low, np.inf).min(0, initial=np.inf) for j in range(k)], 1)
        hi = np.stack([np.where(has[:, j : j + 1], high, -np.inf).max(0, initial=-np.inf) for j in range(k)], 1)
        return {"n": m.T @ m, "sx": s, "sy": s.T, "sxx": q, "syy": q.T, "sxy": v.T @ v, "lox": lo, "loy": lo.T, "hix": hi, "hiy": hi.T}

    def handed_on(tables: dict, kind) -> pa.RecordBatch:
        size = len(above[0])
        out = {"ia": np.tile(above[0], len(tables)).astype(np.int32), "ib": np.tile(above[1], len(tables)).astype(np.int32),
               "g": pa.array([g for g in tables for _ in range(size)], kind)}
        return pa.RecordBatch.from_pydict(out | {name: np.concatenate([t[name][above] for t in tables.values()]) for name in (*MOMENTS, *ENDS)})

    def run(batches):
        tables, kind = {}, None
        for batch in batches:
            kind, values = batch.schema.field("_g").type, _numbers(batch, k)
            for g, rows in _grouped_rows(batch, "_g"):
                new, held = moments(values[rows]), tables.get(g)
                if held:
                    new = {n: held[n] + new[n] if n in MOMENTS else (np.minimum if n.startswith("lo") else np.maximum)(held[n], new[n]) for n in new}
                tables[g] = new
            if len(tables) * 10 * k * k > HELD:
                yield handed_on(tables, kind)
                tables = {}
        if tables:
            yield handed_on(tables, kind)

    narrow = df.select(col(group).alias("_g"), *[col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    fields = ", ".join(f"{n} double" for n in (*MOMENTS, *ENDS))
    parts = narrow.mapInArrow(run, f"ia int, ib int, g {df.schema[group].dataType.simpleString()}, {fields}")
    return parts.withColumnRenamed("g", group)


def added(parts: DataFrame, group: str) -> DataFrame:
    """Partial moments of equal pairs and groups, added up."""
    ends = [(F.min if n.startswith("lo") else F.max)(n).alias(n) for n in ENDS]
    return parts.groupBy("ia", "ib", group).agg(*[F.sum(n).alias(n) for n in MOMENTS], *ends)


def correlation(min_pairs: int) -> Column:
    """Pearson's r from moments; null below `min_pairs` rows or where a side is constant."""
    n, sx, sy, sxx, syy, sxy = (F.col(x) for x in MOMENTS)
    varies = (F.col("lox") < F.col("hix")) & (F.col("loy") < F.col("hiy"))
    spread = F.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(sxy - sx * sy / n, spread)))
    return F.when((n >= min_pairs) & varies, r)
