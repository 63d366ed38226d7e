"""Centroid clustering of integer vectors by a bisector tournament.

Between two centroids i < j lies the hyperplane of equal distance: with the integer normal
n = 2 (c_j - c_i) and threshold t = |c_j|^2 - |c_i|^2, a vector x is nearer to j exactly if n . x > t.
Centroids meet one after the other: the winner so far plays the next one, the sign of n . x - t
eliminates the loser and zero favours the smaller number. After k - 1 linear tests the nearest centroid
is left, without a distance being taken; only its own is, exactly, at the end.

All arithmetic is in integers. Components that are too large for 64-bit sums are worked on with
Python's integers, more slowly and as exactly.

Centroids, normals and sums are k x d numbers. A round is one map over the vectors, whose tasks hand
on one row for each cluster, and one aggregation of those rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditfeat.llm.common import pick, ship_package

#: Components below this have squared distances and normals that 64 bits hold (up to 2**10 components).
SAFE = 1 << 25
SLICE_ROWS = 20_000


@dataclass(frozen=True)
class Clusters:
    """``k`` centroids, ``rounds`` of moving them, ``dims``: components of a vector, ``scale``: a
    component x becomes floor(scale * x); ``seed``: of the choice of the first centroids."""

    k: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64
    seed: int = 1


def usable(vectors: DataFrame, how: Clusters = Clusters()) -> DataFrame:
    """vec_id, ``x`` (array of double) of the vectors with ``dims`` components, none null or
    non-finite."""
    rows = pick(vectors, vec_id="bigint", embedding="array<double>").withColumnRenamed("embedding", "x")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter((F.size("x") == how.dims) & F.coalesce(fine, F.lit(False)))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's where they are too large for exact sums."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * float(scale))
    if not len(scaled) or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    if not np.isfinite(scaled).all():
        raise OverflowError("a component times the scale is beyond the range of double")
    out = np.empty(scaled.shape, object)
    out.flat = [int(v) for v in scaled.flat]
    return out


class Tournament:
    """The bisectors of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]) -> None:
        c = np.array(centroids, object).reshape(len(centroids), -1)
        normals = 2 * (c[None, :] - c[:, None])
        squares = (c * c).sum(axis=1)
        thresholds = squares[None, :] - squares[:, None]
        small = not c.size or max(abs(v) for v in c.flat) < SAFE
        self.wide = (c, normals, thresholds)
        self.narrow = tuple(a.astype(np.int64) for a in self.wide) if small else None

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector and the squared distance to it."""
        c, normals, thresholds = self.narrow if self.narrow and x.dtype != object else self.wide
        if x.dtype != c.dtype:
            x = x.astype(object)
        winner = np.zeros(len(x), np.int64)
        for j in range(1, len(c)):
            for i in np.unique(winner):  # the vectors whose winner so far is i meet one bisector
                at = np.flatnonzero(winner == i)
                winner[at[x[at] @ normals[i, j] > thresholds[i, j]]] = j
        apart = x - c[winner]
        return winner, (apart * apart).sum(axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def first_centroids(rows: DataFrame, how: Clusters) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest hashes; of repeated ids the smaller vector comes
    first. Vectors without an id are no first centroids. Fewer vectors make fewer centroids."""
    key = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.filter("vec_id is not null").orderBy(key, "x").limit(how.k).select("x").collect()
    return [[int(v) for v in integers(np.array([r["x"]], float), how.scale)[0]] for r in chosen]


def moved(rows: DataFrame, centroids: list[list[int]], how: Clusters) -> list[list[int]]:
    """Every centroid at the floor of the mean of its vectors; those without vectors stay."""
    tournament = Tournament(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), how.dims), object)
        for batch in _slices(batches):
            x = integers(_matrix(batch.column(0), how.dims), how.scale)
            of, _ = tournament(x)
            for c in np.unique(of):
                mine = x[of == c]
                count[c] += len(mine)
                sums[c] += mine.sum(axis=0).astype(object)
        held = np.flatnonzero(count)
        texts = [[str(v) for v in sums[c]] for c in held]
        columns = [pa.array(held), pa.array(count[held]), pa.array(texts, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    parts = rows.select("x").mapInArrow(run, "cluster bigint, n bigint, sums array<string>")
    totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(how.dims)]
    out = [list(c) for c in centroids]
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # k rows
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(how.dims)]
    return out


def assigned(rows: DataFrame, centroids: list[list[int]], how: Clusters) -> DataFrame:
    """vec_id, ``cluster`` and ``distance`` (squared) of every vector."""
    tournament = Tournament(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            of, distance = tournament(integers(_matrix(batch.column(1), how.dims), how.scale))
            columns = [batch.column(0), pa.array(of.astype(np.int32)), pa.array(distance.tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def centroid_clusters(vectors: DataFrame, how: Clusters = Clusters()) -> DataFrame:
    """vec_id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` (both decimals) and ``centroid``
    (array of long) for every usable row of ``vectors`` (vec_id, embedding).

    Vectors that are null, of another length, or hold null or non-finite components take no part and
    give no row. Rows with a null id take part but are no first centroids; repeated rows count as
    often as they occur. Fewer than ``k`` rows with an id make fewer centroids; without any there is no
    row. Ties of distance go to the smaller number. Further columns are ignored.
    """
    ship_package(vectors.sparkSession)
    rows = usable(vectors, how)
    centroids = first_centroids(rows, how)
    if not centroids:
        rows = rows.limit(0)
        centroids = [[0] * how.dims]
    for _ in range(how.rounds):
        centroids = moved(rows, centroids, how)
    found = assigned(rows, centroids, how)
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    inertia = {r["cluster"]: int(r["d"]) for r in each}
    # Sums of distances may be beyond 64 bits.
    long = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    of_cluster = F.array(*[long(inertia.get(c, 0)) for c in range(len(centroids))])
    points = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in c]) for c in centroids])
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster[F.col("cluster")].alias("cluster_inertia"),
        long(sum(inertia.values())).alias("inertia"),
        points[F.col("cluster")].alias("centroid"),
    )


def point_hash(point: Column) -> Column:
    """Hex SHA-256 of the components as decimal integers, joined by commas."""
    return F.sha2(F.array_join(point.cast("array<string>"), ","), 256)
