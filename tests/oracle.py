"""Runs registered queries next to their SQL in DuckDB and compares whole results."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    if sql is None:
        return ("rows only" if rows else "EMPTY"), len(rows)
    rel = con.sql(sql)
    types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if sorted(types) != names:
        return f"COLUMNS {names} != {sorted(types)}", len(rows)
    odd = {n: (t, types[n]) for n, t in df.dtypes if TYPES.get(t, t) != types[n]}
    if odd:
        return f"TYPES {odd}", len(rows)
    order = [rel.columns.index(n) for n in names]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    a, b = Counter(map(repr, rows)), Counter(map(repr, want))
    if a != b:
        left, right = list((a - b).elements()), list((b - a).elements())
        return (f"VALUES {len(left)}/{len(rows)} vs {len(right)}/{len(want)}\n   columns {names}\n"
                f"   spark  {sorted(left)[:3]}\n   duckdb {sorted(right)[:3]}"), len(rows)
    return "ok", len(rows)


def main(argv) -> int:
    from tidegauge.session import local_session

    import __spark_entry__ as entry

    pattern = argv[1] if len(argv) > 1 else ""
    sf_dir = argv[2] if len(argv) > 2 else "/root/testdata/sf0.01"
    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if not any(name.startswith(p) for p in pattern.split(",")):
            continue
        start = time.time()
        try:
            verdict, n = compare(spark, con, sf_dir, fn, sql.get(name))
        except Exception as e:  # one broken query must not hide the others
            verdict, n = f"ERROR {type(e).__name__}: {str(e)[:700]}", -1
        ok = verdict in ("ok", "rows only")
        bad += not ok
        print(f"{'  ' if ok else '! '}{name:40s} {n:7d} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
