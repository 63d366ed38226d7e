"""Exact nearest-neighbour join by pivots: every row meets those parts of the table only that can hold
one of its neighbours.

1. Pivots are vectors drawn by hash. Every vector belongs to the cell of its nearest pivot, and a cell's
   radius is the largest distance of its vectors from the pivot.
2. A row first visits the nearest cells that hold k vectors together. The k-th distance found there
   bounds that of the row's k-th neighbour.
3. It then visits the other cells that may hold something as near: neither the triangle inequality
   (distance from the pivot less the radius) nor the plane half way between its own pivot and the
   other one excludes them.
4. The lists of all visits are merged, the k first of each row.

Visits are rows of a shuffle, so vectors go where they are needed and nothing but pivots and the cells'
sizes goes through the driver. Equal vectors are one query, and of equal vectors only the k smallest
keys can be neighbours, so a frequent vector is no hot spot; large cells are cut into chunks, and
frequently visited ones are met in blocks of visitors. Where distances say little, as in many unrelated
dimensions, hardly a cell is excluded and the work is that of all pairs, as for any exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditfeat.operators import neighbour_search as ns
from creditfeat.operators.metric_moments import NO_FOLD, matrix, metric_moments
from creditfeat.staging import ship_package, stage

BLOCK_ROWS = 100_000  # vectors that a task compares visitors with
VISITORS = 16_384  # visitors of a chunk that a task handles
MOST_PIVOTS = 1024
PIVOT_SEED = 9
SLICE = 4096
_LIST = "point bigint, distance2 double, neighbour bigint, label int"


def _gaps(z: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ns.distances(z, pivots)


def _placed(df: DataFrame, keep: list[str], dims: int, mean: np.ndarray, scale: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``keep``, the scaled vector ``z`` as bytes, the ``cell`` and the distance ``gap`` from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, len(batch), SLICE)):
                z = (matrix(part.column(len(keep)), dims) - mean) / scale
                gap = _gaps(z, pivots)
                cell = gap.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(keep)],
                        pa.array([v.tobytes() for v in z], pa.binary()),
                        pa.array(cell.astype(np.int32)),
                        pa.array(gap[np.arange(len(z)), cell]),
                    ],
                    [*keep, "z", "cell", "gap"],
                )

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, "x").mapInArrow(run, f"{kinds}, z binary, cell int, gap double")


def _visits(queries: DataFrame, pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int, bounded: bool) -> DataFrame:
    """(point, z, bound, cell): the first visits of every query, or (``bounded``, with its k-th squared distance
    so far) the further ones."""
    between = _gaps(pivots, pivots)
    filled = sizes > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, len(batch), SLICE)):
                z = np.frombuffer(b"".join(part.column(1).to_pylist())).reshape(len(part), -1)
                gap = _gaps(z, pivots)
                order = np.argsort(gap, axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                first = np.zeros(gap.shape, bool)
                # The nearest cells up to the one with which there are k vectors.
                np.put_along_axis(first, order, np.concatenate([np.zeros((len(z), 1)), held[:, :-1]], axis=1) < k, axis=1)
                if bounded:
                    own = gap.argmin(axis=1)
                    plane = (np.square(gap) - np.square(gap[np.arange(len(z)), own])[:, None]) / (2 * np.maximum(between[own], 1e-12))
                    lower = np.maximum(gap - radii, plane)
                    bound = part.column(2).to_numpy(zero_copy_only=False)
                    reach = np.sqrt(bound + 10.0**-ns.DECIMALS)
                    chosen = ~first & filled & (lower * (1 - 1e-9) - 1e-6 <= reach[:, None])
                else:
                    chosen = first & filled
                row, cell = np.nonzero(chosen)
                took = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [took.column(0), took.column(1), took.column(2), pa.array(cell.astype(np.int32))],
                    ["point", "z", "bound", "cell"],
                )

    return queries.select("point", "z", "bound").mapInArrow(run, "point bigint, z binary, bound double, cell int")


def _met(visits: DataFrame, refs: DataFrame, sizes: dict[int, int], dims: int, k: int, block_rows: int) -> DataFrame:
    """(point, distance2, neighbour, label): up to k for each visit to a chunk."""
    visits = stage(visits, "visits")
    often = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    plan = [(c, -(-sizes[c] // block_rows), -(-n // VISITORS)) for c, n in often.items()]
    plan = F.broadcast(visits.sparkSession.createDataFrame(plan, "cell int, chunks int, blocks int"))
    keys = ["cell", "chunk", "block"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    left = left.withColumn("chunk", every("chunks")).select(*keys, "point", "z", "bound")
    right = refs.join(plan, "cell").withColumn("chunk", F.pmod(F.xxhash64("key", "label", "z"), F.col("chunks")).cast("int"))
    right = right.withColumn("block", every("blocks")).select(*keys, "key", "label", "z")

    def search(who: pd.DataFrame, where: pd.DataFrame) -> pd.DataFrame:
        if not len(who) or not len(where):
            return pd.DataFrame({"point": [], "distance2": [], "neighbour": [], "label": []})
        q, points = (np.frombuffer(b"".join(t["z"])).reshape(-1, dims) for t in (who, where))
        middle = points.mean(axis=0, keepdims=True)
        radius = ns.distances(points, middle).max(axis=0)
        ref = ns.Reference(points, where["key"].to_numpy(), where["label"].to_numpy(), np.array([0, len(points)]), middle, radius)
        d2, keys_, labels = ns.nearest(q, ref, k)
        row, place = np.nonzero(np.isfinite(d2) & (d2 <= who["bound"].to_numpy()[:, None] + 10.0**-ns.DECIMALS))
        return pd.DataFrame(
            {"point": who["point"].to_numpy()[row], "distance2": d2[row, place], "neighbour": keys_[row, place], "label": labels[row, place]}
        )

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, _LIST)


def _first_k(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("point").orderBy("distance2", "neighbour", "label")
    return lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_rows(
    df: DataFrame, vector: Column, key: str, label: str, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(key, place, neighbour, distance, label): the k nearest of all rows for every row.

    Vectors are scaled to unit variance. Ties of the distance (to 9 decimals) go to smaller keys. Rows
    without a vector have no list; rows without key, label or vector are no neighbours."""
    names = ["key", "place", "neighbour", "distance", "label"]
    spark = df.sparkSession
    ship_package(spark)
    rows = stage(
        df.select(
            F.col(key).cast("bigint").alias("key"),
            F.col(label).cast("int").alias("label"),
            vector.cast("array<double>").alias("x"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    base = rows.dropna()
    n, dims, moments = metric_moments(base.withColumn("fold", F.lit(-2)), [])
    empty = "key bigint, place int, neighbour bigint, distance double, label int"
    if not n:
        return spark.createDataFrame([], empty)
    mean, scale = moments[NO_FOLD].mean, moments[NO_FOLD].scale
    # Of equal vectors only the k smallest keys can be among k neighbours.
    by_key = Window.partitionBy("x").orderBy("key", "label", "row")
    refs = base.withColumn("_n", F.row_number().over(by_key)).where(F.col("_n") <= k).drop("_n")
    # Equal vectors are one query; ``point`` is its number.
    points = stage(rows.where("x is not null").groupBy("x").agg(F.min("row").alias("point")), "points")
    cells = max(1, min(MOST_PIVOTS, math.ceil(4 * n / block_rows)))
    drawn = points.orderBy(F.xxhash64("point", F.lit(PIVOT_SEED)), "point").limit(cells).select("x").collect()
    pivots = (np.array([r["x"] for r in drawn], float).reshape(len(drawn), dims) - mean) / scale

    refs = stage(_placed(refs, ["key", "label"], dims, mean, scale, pivots), "placed")
    queries = stage(_placed(points, ["point"], dims, mean, scale, pivots), "queries")
    stats = refs.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()  # a row a cell
    sizes, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in stats:
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    of_cell = dict(enumerate(sizes.tolist()))

    unbound = queries.withColumn("bound", F.lit(float("inf")))
    first = _met(_visits(unbound, pivots, sizes, radii, k, False), refs, of_cell, dims, k, block_rows)
    lists = stage(_first_k(first, k), "lists")
    if len(pivots) > 1:
        worst = lists.where(F.col("place") == k).select("point", F.col("distance2").alias("bound"))
        bound = queries.join(worst, "point", "left").na.fill(float("inf"), ["bound"])
        more = _met(_visits(bound, pivots, sizes, radii, k, True), refs, of_cell, dims, k, block_rows)
        lists = _first_k(lists.drop("place").unionByName(more), k)
    of_row = rows.where("x is not null").join(points, "x").select("key", "point")
    found = lists.join(of_row, "point")
    return found.withColumn("distance", F.sqrt("distance2")).select(*names)
