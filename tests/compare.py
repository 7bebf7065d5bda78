"""Compare registered queries with their SQL: ``python tests/compare.py SF_DIR [QUERY...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return float(f"{float(x):.9g}") if type(x).__name__ == "Decimal" else x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf: str, name: str, f, sql: str) -> str:
    """Empty if columns and rows agree."""
    df = f(spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = connection(sf).execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; only here {a}, only in SQL {b}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or [n for n in q if not (n[:2] == "op" and n[2].isdigit()) and n != "pipeline"]:
        t = time.time()
        try:
            why = compare(spark, sys.argv[1], name, q[name], o[name]) if name in o else f"no SQL, {q[name](spark, sys.argv[1]).count()} rows"
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:300]}"
        print(f"{name}: {time.time() - t:.1f} s {why or 'same'}", flush=True)
