"""Run every registered query next to its SQL and compare all rows."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        tuple(normal(r[i]) for i in order) for r in data
    )


def check(spark, con, folder, name, query, sql):
    """Return (problem or None, number of rows, seconds)."""
    start = time.time()
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    took = time.time() - start
    result = con.execute(sql)
    want = rows([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), took
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return (
            f"{len(got[1])} rows against {len(want[1])}; only ours {sorted(a - b)[:2]}; "
            f"only SQL {sorted(b - a)[:2]}"
        ), len(got[1]), took
    return None, len(got[1]), took


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = views(folder)
    bad = 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            problem, n, took = check(spark, con, folder, name, query, oracle_sql()[name])
        except Exception as error:
            problem, n, took = f"{type(error).__name__}: {str(error)[:1500]}", -1, 0
        bad += problem is not None
        print(f"RESULT {name:24} {n:7} rows {took:6.2f}s {problem or 'ok'}", flush=True)
    print("RESULT problems:", bad)
