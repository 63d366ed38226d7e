"""Data-quality checks. Each gives one or more rows (check, passed, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from creditfeat.operators.joins import duplicate_keys
from creditfeat.operators.profile import class_balance, label_correlation
from creditfeat.staging import stage

SCHEMA = "check string, passed boolean, detail bigint"


def _one(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """A check that counts violations."""
    return df.agg(bad.cast("bigint").alias("detail")).select(
        F.lit(name).alias("check"), (F.col("detail") == 0).alias("passed"), "detail"
    )


def no_nulls(df: DataFrame, name: str = "no_nulls") -> DataFrame:
    per_row = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return _one(df, name, F.coalesce(F.sum(per_row), F.lit(0)))


def same_rows(before: DataFrame, after: DataFrame, name: str = "row_count") -> DataFrame:
    """A join must keep the number of rows; detail is the difference."""
    left = before.agg(F.count(F.lit(1)).alias("a"))
    right = after.agg(F.count(F.lit(1)).alias("b"))
    both = left.crossJoin(right)  # one row each
    return both.select(
        F.lit(name).alias("check"),
        (F.col("a") == F.col("b")).alias("passed"),
        (F.col("b") - F.col("a")).alias("detail"),
    )


def key_unique(df: DataFrame, key: str, name: str = "key_unique") -> DataFrame:
    return _one(duplicate_keys(df, key), name, F.count(F.lit(1)))


def label_domain(df: DataFrame, label: str, name: str = "label_domain") -> DataFrame:
    return _one(df, name, F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)))


def allowed_values(
    df: DataFrame, column: str, allowed: Sequence[str], name: str = "allowed_values"
) -> DataFrame:
    """Rows whose value is not in the list (null counts as a violation)."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return _one(df, name, F.count_if(~ok))


def unexpected_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """The offending values with their counts."""
    listed = df.sparkSession.createDataFrame([(a,) for a in allowed], "value string")
    return (
        df.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(listed, "value", "left_anti")
    )


def numeric_type(df: DataFrame, column: str, name: str = "numeric_type") -> DataFrame:
    bad = df.schema[column].dataType.simpleString() not in ("double", "bigint", "int", "float")
    return df.sparkSession.createDataFrame([(name, not bad, int(bad))], SCHEMA)


def split_rates(
    df: DataFrame, label: str, split: str = "split", tolerance: float = 0.01
) -> DataFrame:
    """(split, negatives, positives, rate, passed): every split near the overall rate."""
    overall = class_balance(df, label).select(F.col("rate").alias("_all"))
    return (
        class_balance(df, label, [split])
        .crossJoin(F.broadcast(overall))  # one row
        .withColumn("passed", F.abs(F.col("rate") - F.col("_all")) <= tolerance)
        .drop("ratio", "_all")
    )


def recomputed(
    df: DataFrame, column: str, expected: Column, tolerance: float = 0.01, name: str = "recompute"
) -> DataFrame:
    """Stored values against recomputed ones; one-sided nulls count as violations."""
    both_null = F.col(column).isNull() & expected.isNull()
    close = F.coalesce(F.abs(F.col(column) - expected) < tolerance, F.lit(False))
    return _one(df, name, F.count_if(~(both_null | close)))


def leak_report(
    df: DataFrame,
    pairs: Sequence[tuple[str, str, str]],
    label: str,
    alarm: float = 0.9,
) -> DataFrame:
    """(feature, oof_correlation, in_sample_correlation, suspicious) for triples
    (feature, out-of-fold column, in-sample column)."""
    columns = [c for _, oof, own in pairs for c in (oof, own)]
    found = label_correlation(df, columns, label)
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), F.lit(kind).alias("kind"), F.lit(c).alias("c"))
            for name, oof, own in pairs
            for kind, c in (("oof", oof), ("own", own))
        ]
    )
    named = found.withColumn("m", F.explode(F.filter(rows, lambda r: r["c"] == F.col("column"))))
    pick = lambda kind: F.max(F.when(F.col("m.kind") == kind, F.col("correlation")))
    return (
        named.groupBy(F.col("m.feature").alias("feature"))
        .agg(pick("oof").alias("oof_correlation"), pick("own").alias("in_sample_correlation"))
        .withColumn("suspicious", F.col("oof_correlation") > alarm)
    )


def run_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, checks)


def raise_on_failure(report: DataFrame) -> None:
    bad = report.where(~F.col("passed")).collect()  # one row per check
    if bad:
        raise AssertionError(", ".join(f"{r['check']}: {r['detail']}" for r in bad))


def staged_with_checks(
    df: DataFrame,
    name: str,
    no_nulls_in: Sequence[str] = (),
    label: str | None = None,
    scores: Sequence[str] = (),
) -> tuple[DataFrame, dict]:
    """``df`` staged, and what was observed while it was written: ``rows``, ``nulls`` in the named columns,
    ``bad_labels`` (not 0 or 1), ``positives``, and per score its ``min_``, ``mean_`` and ``max_``. No further
    scan is made. Raises if there are nulls, bad labels, or scores outside 0 to 1."""
    seen = Observation(name)
    null_in = sum((F.col(c).isNull().cast("int") for c in no_nulls_in), F.lit(0))
    found = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(null_in), F.lit(0)).alias("nulls")]
    if label is not None:
        bad = F.col(label).isNull() | ~F.col(label).isin(0, 1)
        found += [F.count_if(bad).alias("bad_labels"), F.coalesce(F.sum(label), F.lit(0)).alias("positives")]
    for c in scores:
        found += [F.min(c).alias(f"min_{c}"), F.avg(c).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}")]
    written = stage(df.observe(seen, *found), name)
    metrics = dict(seen.get)
    bad = {k: metrics[k] for k in ("nulls", "bad_labels") if metrics.get(k)}
    for c in scores:
        if metrics["rows"] and metrics[f"min_{c}"] is not None and not 0 <= metrics[f"min_{c}"] <= metrics[f"max_{c}"] <= 1:
            bad[c] = (metrics[f"min_{c}"], metrics[f"max_{c}"])
    if bad:
        raise AssertionError(f"{name}: {bad}")
    return written, metrics
