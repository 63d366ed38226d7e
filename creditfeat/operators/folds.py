"""Deterministic stratified folds and train/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
_SHUFFLE_DIGITS = 4  # hex digits of the hash that spread one class over tasks: 65,536 pieces


def shuffle_hash(key: str, seed: int = SEED) -> Column:
    """The pseudo-random order of rows: md5 of key and seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def class_positions(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """Add ``_pos``, the 1-based place of a row inside its class in hash order, and
    ``_class_rows``, the size of the class.

    Same result as ``row_number() over (partition by label order by hash, key)``, but a
    class is spread over many tasks: rows are numbered inside one hash prefix, then
    shifted by the number of rows with smaller prefixes.
    """
    hashed = df.withColumn("_hash", shuffle_hash(key, seed)).withColumn(
        "_prefix", F.substring("_hash", 1, _SHUFFLE_DIGITS)
    )
    of_class = Window.partitionBy("_of_label")
    earlier = of_class.orderBy("_of_prefix").rowsBetween(Window.unboundedPreceding, -1)
    # 65,536 rows per class at most, whatever the size of the data.
    shifts = (
        hashed.groupBy(F.col(label).alias("_of_label"), F.col("_prefix").alias("_of_prefix"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_of_label",
            "_of_prefix",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(of_class).alias("_class_rows"),
        )
    )
    inside = Window.partitionBy(label, "_prefix").orderBy("_hash", key)
    # Null-safe, so that rows without a label keep their place too.
    here = F.col(label).eqNullSafe(F.col("_of_label")) & F.col("_prefix").eqNullSafe(
        F.col("_of_prefix")
    )
    return (
        hashed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(shifts), here)
        .withColumn("_pos", F.col("_rn") + F.col("_before"))
        .drop("_hash", "_prefix", "_of_label", "_of_prefix", "_rn", "_before")
    )


def with_folds(
    df: DataFrame, key: str, label: str, n_folds: int = 5, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Add a stratified fold number 0 … n_folds-1."""
    placed = class_positions(df, key, label, seed)
    return placed.withColumn(name, ((F.col("_pos") - 1) % n_folds).cast("int")).drop(
        "_pos", "_class_rows"
    )


def with_split(
    df: DataFrame,
    key: str,
    label: str,
    test_share: float = 0.2,
    seed: int = SEED,
    name: str = "split",
) -> DataFrame:
    """Add ``split`` = 'test' for the given share of every class, 'train' for the rest."""
    placed = class_positions(df, key, label, seed)
    is_test = F.col("_pos") <= F.ceil(F.lit(float(test_share)) * F.col("_class_rows"))
    return placed.withColumn(name, F.when(is_test, "test").otherwise("train")).drop(
        "_pos", "_class_rows"
    )
