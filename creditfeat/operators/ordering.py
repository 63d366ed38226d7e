"""Ordered computations (running totals, exact quantiles) that never sort one large
group in one task.

Input tables hold one row per distinct value with integer weights, so a value that
holds a third of all rows is still a single row here. The values are dealt into ranges of
about ``rows_per_task`` rows, whatever the groups; each range is summed locally and shifted by
the totals of the ranges before it. The ranges only steer the work, the results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditfeat.staging import stage

ROWS_PER_TASK = 500_000


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on equality for which null equals null: a null group is a group like others."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(right, same, how).drop(*[f"_r_{c}" for c in on])


def running_totals(
    counts: DataFrame,
    value: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``cum_<m>``: the total of measure ``m`` up to and including this row's value.

    ``counts`` has one row per (by, value) and no null values. It is read twice: stage it if it
    is costly. The ranges are staged with their numbers, so that all that follows sees the same ones; a
    range spans the end of one group, whole groups, and the beginning of another.
    """
    by = list(by)
    ranges = max(1, math.ceil(counts.count() / rows_per_task))
    order = F.col(value).desc() if descending else F.col(value).asc()
    dealt = counts.repartitionByRange(ranges, *by, order) if ranges > 1 else counts.coalesce(1)
    dealt = stage(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    # One row for each range and group in it: fewer than ranges + groups.
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy(*by, "_range")
        .agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
        .select(
            *by,
            "_range",
            *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_s_{m}") for m in measures],
        )
    )
    upto = (
        Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = dealt.withColumns({f"cum_{m}": F.sum(m).over(upto) for m in measures})
    out = _join_null_safe(local, shifts, [*by, "_range"], "inner")
    return out.withColumns({f"cum_{m}": F.col(f"cum_{m}") + F.col(f"_s_{m}") for m in measures}).drop(
        "_range", *[f"_s_{m}" for m in measures]
    )


def weighted_quantiles(
    counts: DataFrame,
    value: str,
    weights: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact quantiles with linear interpolation, for several weightings of the same values.

    Returns one row per (by, weight, prob_index) with ``q``. ``counts`` has one row per
    (by, value) with integer weights, as for :func:`running_totals`.
    """
    by = list(by)
    spark = counts.sparkSession
    totals = counts.groupBy(*by).agg(*[F.sum(w).alias(w) for w in weights]).collect()
    rows = []
    for total in totals:
        for w, name in enumerate(weights):
            for i, p in enumerate(probs if total[name] else []):
                place = (total[name] - 1) * p
                low, high = math.floor(place), math.ceil(place)
                own = (*[total[b] for b in by], w, i)
                rows += [(*own, False, low, place - low), (*own, True, high, place - low)]
    ranks = T.StructType(
        [T.StructField(b, counts.schema[b].dataType) for b in by]
    ).add("weight", "integer").add("prob_index", "integer").add("upper", "boolean")
    ranks = ranks.add("rank", "long").add("frac", "double")
    # groups x weights x probs x 2 rows
    wanted = F.broadcast(spark.createDataFrame(rows, ranks))

    run = running_totals(counts, value, weights, by, rows_per_task=rows_per_task)
    spans = F.array(
        *[
            F.struct(
                F.lit(w).alias("weight"),
                F.col(f"cum_{name}").cast("bigint").alias("upto"),
                F.col(name).cast("bigint").alias("own"),
            )
            for w, name in enumerate(weights)
        ]
    )
    hits = (
        run.select(*by, F.col(value).cast("double").alias("_value"), F.inline(spans))
        .where("own > 0")
        .join(wanted, [*by, "weight"])
        .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("own") <= F.col("rank")))
    )
    return (
        hits.groupBy(*by, "weight", "prob_index")
        .agg(
            F.min(F.when(~F.col("upper"), F.col("_value"))).alias("_low"),
            F.min(F.when(F.col("upper"), F.col("_value"))).alias("_high"),
            F.max("frac").alias("_frac"),
        )
        .withColumn("q", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_frac"))
        .drop("_low", "_high", "_frac")
    )


def column_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (column, value, *keep) of numeric columns; null values are left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(pairs), *keep).where(F.col("value").isNotNull())


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of several columns: (column, prob_index, q)."""
    counts = stage(
        column_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")),
        "values",
    )
    return weighted_quantiles(counts, "value", ["n"], probs, ["column"]).drop("weight")
