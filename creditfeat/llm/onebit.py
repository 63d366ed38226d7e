"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is taken relative to a centre, rotated by one random rotation and kept as one bit for
each dimension with two scalars: its length, and the inner product of the unit vector with its own
code. From these the inner product with a query is estimated without bias, with an error that shrinks
with the square root of the dimensions. Only vectors whose lower bound of distance reaches the k-th
upper bound are compared exactly.

Queries are set against all codes in blocks: a task holds one block of codes and one chunk of
queries, both of bounded size, and keeps k rows for each query. Nothing is pruned but by the bounds,
so recall doesn't depend on how the vectors cluster; the work is queries times codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditfeat.llm.common import pick, ship_package, stage


@dataclass(frozen=True)
class Codes:
    """``sample_rows``: vectors the centre is the mean of, first by hash of their id, at most;
    ``width``: standard errors of the bounds; ``block_rows``, ``chunk_rows``: codes and queries that
    a task holds, about."""

    sample_rows: int = 10_000
    width: float = 3.0
    block_rows: int = 8192
    chunk_rows: int = 2048
    seed: int = 11


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, and their dimension.

    Rows with a null id or vector, null or non-finite components or zeros only take no part, nor do
    vectors of another than the most frequent dimension. Of several rows of an id the smallest
    vector holds. Further columns are ignored.
    """
    rows = pick(vectors, **{key: "bigint", vector: "array<float>"}).toDF("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count()
    first = sizes.orderBy(F.desc("count"), "dim").first()
    dim = first["dim"] if first else 0
    rows = rows.filter(F.size("embedding") == dim)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), dim


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids: no other can be among any query's k nearest, as
    equal vectors tie and ties go to smaller ids. Exact, and no vector stays hot."""
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def encode(rows: DataFrame, dim: int, center: np.ndarray, how: Codes = Codes()) -> DataFrame:
    """Adds ``code`` (packed bits), ``length`` and ``aligned`` (the correction scalars)."""
    ship_package(rows.sparkSession)
    turn = rotation(dim, how.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = (_matrix(batch.column(1), dim).astype(np.float64) - center) @ turn.T
            length = np.linalg.norm(away, axis=1)
            aligned = np.abs(away).sum(axis=1) / np.sqrt(dim) / np.maximum(length, 1e-300)
            bits = np.packbits(away > 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([b.tobytes() for b in bits], pa.binary()),
                    pa.array(length),
                    pa.array(aligned),
                ],
                ["vec_id", "embedding", "code", "length", "aligned"],
            )

    kind = "vec_id bigint, embedding array<float>, code binary, length double, aligned double"
    return rows.select("vec_id", "embedding").mapInArrow(run, kind)


def estimate(
    query: np.ndarray, code: np.ndarray, length: np.ndarray, aligned: np.ndarray, dim: int, width: float
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances of rotated, centred queries from coded vectors."""
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    size = np.linalg.norm(query, axis=1)
    unit = query / np.maximum(size, 1e-300)[:, None]
    safe = np.maximum(aligned, 1e-12)
    inner = (unit.astype(np.float32) @ signs.T).astype(np.float64) / np.sqrt(dim) / safe
    error = width * np.sqrt(np.maximum(0, 1 - aligned**2)) / safe / np.sqrt(max(1, dim - 1))
    near = size[:, None] ** 2 + length[None] ** 2 - 2 * size[:, None] * length[None] * inner
    # Rounding of single precision, on top of the statistical error.
    slack = 2 * size[:, None] * length[None] * (error[None] + 1e-5) + 1e-12
    return near - slack, near + slack


def search(vectors: DataFrame, every: int = 100, k: int = 10, how: Codes = Codes()) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in double precision) of the k nearest of
    every query, the rows whose id is divisible by ``every``.

    A query's own row is no candidate. Ties go to the smaller id. Fewer candidates than k give fewer
    rows; an empty table gives an empty result. See ``usable`` for rows that take no part.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows, dim = usable(vectors)
    rows = stage(rows, "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(how.sample_rows)
    axes = [F.avg(F.col("embedding")[i].cast("double")) for i in range(dim)]
    center = np.array(sample.agg(*axes).first(), float) if dim else np.zeros(0)
    center = np.nan_to_num(center)
    codes = stage(encode(distinct_vectors(rows, k), dim, center, how), "codes")
    queries = rows.filter(F.col("vec_id") % every == 0)
    n_codes, n_queries = codes.count(), queries.count()
    blocks = max(1, -(-n_codes // how.block_rows))
    chunks = max(1, -(-n_queries // how.chunk_rows))

    def dealt(key: str, parts: int, salt: str):
        return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(parts)).cast("int")

    def all_of(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = queries.select(
        "vec_id", "embedding", dealt("vec_id", chunks, "query").alias("chunk"), all_of(blocks).alias("block")
    )
    right = codes.select(
        "*", dealt("vec_id", blocks, "code").alias("block"), all_of(chunks).alias("chunk")
    )
    turn = rotation(dim, how.seed) if dim else np.zeros((0, 0))

    def run(asked: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(asked) and len(coded):
            ids = coded["vec_id"].to_numpy()
            exact = np.stack(coded["embedding"].to_numpy()).astype(np.float64)
            code = np.frombuffer(b"".join(coded["code"]), np.uint8).reshape(len(ids), -1)
            length, aligned = coded["length"].to_numpy(), coded["aligned"].to_numpy()
            query_ids = asked["vec_id"].to_numpy()
            query = np.stack(asked["embedding"].to_numpy()).astype(np.float64)
            for at in range(0, len(query_ids), 128):
                part = query[at : at + 128]
                low, high = estimate((part - center) @ turn.T, code, length, aligned, dim, how.width)
                for i, query_id in enumerate(query_ids[at : at + 128]):
                    own = ids == query_id
                    low[i, own] = high[i, own] = np.inf
                    worth = np.arange(len(ids))
                    if len(ids) > k:
                        worth = np.flatnonzero(low[i] <= np.partition(high[i], k - 1)[k - 1])
                    worth = worth[~own[worth]]
                    score = np.sqrt(np.square(exact[worth] - part[i]).sum(axis=1))
                    best = np.lexsort((ids[worth], score))[:k]
                    found.append((np.full(len(best), query_id), ids[worth][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [[], [], []]
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], columns, strict=True)))

    near = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    hits = near.applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (
        hits.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
