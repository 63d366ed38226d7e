"""Means and scales of vectors, of all rows and of all folds but one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_FOLD = -1


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dims)


@dataclass
class Moments:
    mean: np.ndarray
    scale: np.ndarray


def metric_moments(df: DataFrame, folds: list[int]) -> tuple[int, int, dict[int, Moments]]:
    """Rows, dimensions, and the moments of "all folds but f" for every f and of all rows.

    One aggregation by (fold, dimension); the groups are then merged pairwise."""
    parts = (
        df.select("fold", F.posexplode("x").alias("dim", "v"))
        .groupBy("fold", "dim")
        .agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
        .collect()  # folds x dimensions rows
    )
    dims = max((r["dim"] for r in parts), default=-1) + 1
    by_fold: dict[int, tuple] = {}
    for r in parts:
        n, mean, m2 = by_fold.setdefault(r["fold"], (np.zeros(dims), np.zeros(dims), np.zeros(dims)))
        n[r["dim"]], mean[r["dim"]], m2[r["dim"]] = r["n"], r["mean"], r["var"] * r["n"]

    def merged(skip: int) -> Moments:
        n, mean, m2 = 0.0, np.zeros(dims), np.zeros(dims)
        for f, (n_f, mean_f, m2_f) in sorted(by_fold.items()):
            if f == skip and skip != NO_FOLD:
                continue
            total = n + n_f
            step = mean_f - mean
            m2 = m2 + m2_f + step * step * n * n_f / total
            mean = mean + step * n_f / total
            n = total
        scale = np.sqrt(m2 / np.maximum(n, 1))
        return Moments(mean, np.where(scale > 0, scale, 1.0))

    rows = int(sum(n.max(initial=0) for n, _, _ in by_fold.values()))
    return rows, dims, {f: merged(f) for f in [*folds, NO_FOLD]}
