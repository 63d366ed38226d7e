"""Shared storage for tables that are computed once and read several times.

Everything staged is a plain parquet table in the cluster's shared checkpoint
folder, so losing an executor never loses a staged table.
"""

from __future__ import annotations

import functools
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest fitted table (in rows) that is fetched to the driver and broadcast.
BROADCAST_ROWS = 20_000


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="creditfeat-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/creditfeat/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to shared storage and return a scan over it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(table: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Fix a fitted table: (local relation, True) when it has at most ``limit`` rows,
    else (staged parquet, False)."""
    rows = table.limit(limit + 1).collect()
    if len(rows) <= limit:
        return table.sparkSession.createDataFrame(rows, table.schema), True
    return stage(table, "fitted"), False


def settle_columns(table: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame | None, set[str]]:
    """Fix a fitted table of many columns (``column``, …), each by its own size: a local relation of the
    columns with the fewest rows, ``limit`` rows in all at most, a staged table of the others or
    None, and the names of the former."""
    table = stage(table, "fitted")
    counts = table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each column
    few, total = set(), 0
    for name, n in sorted(((r["column"], r["n"]) for r in counts), key=lambda c: c[::-1]):
        total += n
        if total > limit:
            break
        few.add(name)
    is_few = F.col("column").isin(sorted(few))
    small = table.sparkSession.createDataFrame(table.where(is_few).collect() if few else [], table.schema)
    return small, table.where(~is_few) if len(few) < len(counts) else None, few


def lookup(df: DataFrame, table: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Left join with a fitted table. Only a counted, small table is broadcast; a large one
    is shuffled, where adaptive execution splits hot keys of the left side."""
    return df.join(F.broadcast(table) if small else table, on, "left")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, for the few steps that run Python in tasks."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="creditfeat-code-")) / package.name
    context.addPyFile(
        shutil.make_archive(str(target), "zip", root_dir=package.parent, base_dir=package.name)
    )
    _shipped.add(context.applicationId)
