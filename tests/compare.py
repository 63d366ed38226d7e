"""Run registered queries next to their SQL twins: python -m tests.compare [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as E  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def check(spark, con, name, sf_dir):
    """(seconds, problem or None, rows)."""
    start = time.time()
    df = E.queries()[name](spark, sf_dir)
    got = table_of(df.columns, df.collect())
    took = time.time() - start
    sql = E.oracle_sql().get(name)
    if sql is None:
        return took, None, len(got[1])
    rel = con.execute(sql)
    want = table_of([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return took, f"columns {got[0]} / {want[0]}", len(got[1])
    if got[1] != want[1]:
        left = [r for r in got[1] if r not in set(want[1])][:3]
        right = [r for r in want[1] if r not in set(got[1])][:3]
        return took, f"{len(got[1])}/{len(want[1])} rows; {left} <> {right}", len(got[1])
    return took, None, len(got[1])


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duck(sf)
    names = sys.argv[1:] or list(E.queries())
    bad = 0
    for n in names:
        try:
            took, problem, rows = check(spark, con, n, sf)
        except Exception as e:  # noqa: BLE001
            took, problem, rows = 0, f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += problem is not None
        kind = "sql " if n in E.oracle_sql() else "rows"
        print(f"{'BAD ' if problem else 'ok  '} {kind} {n:28s} {took:6.2f}s {rows:8d} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
