"""Registry of runnable queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECIMALS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Doubles at a fixed precision, without a negative zero, so two engines can be compared."""
    return df.select(*[(F.round(F.col(f"`{n}`"), decimals) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", decimals: int = DECIMALS):
    """Register `fn(t) -> DataFrame`; `t` opens tables. `doubles` names the SQL columns to round."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Tables(spark, sf_dir)), decimals)

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if doubles:
                fixed = ", ".join(f"round({c}, {decimals}) + 0.0 AS {c}" for c in doubles.split())
                text = f"SELECT * REPLACE ({fixed}) FROM ({text}) AS answer"
            SQL[name] = text
        return fn

    return keep


class Tables:
    """The given tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))
