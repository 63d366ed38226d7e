"""Data profiles: each is one aggregation over all columns, turned into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditfeat.operators.ordering import column_quantiles, column_values, running_totals, weighted_quantiles
from creditfeat.staging import lookup, settle, stage


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in kinds and c not in skip]


def _per_column(df: DataFrame, columns: Sequence[str], **stats) -> DataFrame:
    """Rows (column, *stats); every stat is a function of a column name, all in one ``agg``."""
    lines = [
        F.struct(F.lit(c).alias("column"), *[make(c).alias(name) for name, make in stats.items()])
        for c in columns
    ]
    return df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, percent) of the columns that have nulls, most nulls first."""
    return (
        _per_column(
            df,
            columns or df.columns,
            missing=lambda c: F.count_if(F.col(c).isNull()),
            percent=lambda c: F.count_if(F.col(c).isNull()) * F.lit(100.0) / F.count(F.lit(1)),
        )
        .where("missing > 0")
        .orderBy(F.desc("missing"), "column")
    )


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, negatives, positives, rate, ratio): ratio of negatives to positives."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.groupBy(*by).agg(
        neg.alias("negatives"),
        pos.alias("positives"),
        F.try_divide(pos.cast("double"), neg + pos).alias("rate"),
        F.try_divide(neg.cast("double"), pos).alias("ratio"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("value"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct), nulls not counted.

    Two levels of grouping, so a column with many values is counted by many tasks."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("column", "v")
        .agg(F.lit(1).alias("one"))
        .groupBy("column")
        .agg(F.count("v").alias("n_distinct"))
    )


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, median, total): population deviation, exact median."""
    basic = _per_column(
        df,
        columns,
        n=F.count,
        mean=F.avg,
        std=F.stddev_pop,
        total=lambda c: F.sum(F.col(c).cast("double")),
    )
    median = column_quantiles(df, columns, [0.5]).select("column", F.col("q").alias("median"))
    return basic.join(F.broadcast(median), "column", "left")  # one row per column


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, p25, p50, p75, max): sample deviation, exact quartiles."""
    basic = _per_column(
        df,
        columns,
        n=F.count,
        mean=F.avg,
        std=F.stddev_samp,
        min=lambda c: F.min(F.col(c).cast("double")),
        max=lambda c: F.max(F.col(c).cast("double")),
    )
    quartiles = (
        column_quantiles(df, columns, [0.25, 0.5, 0.75])
        .groupBy("column")
        .agg(
            *[
                F.max(F.when(F.col("prob_index") == i, F.col("q"))).alias(name)
                for i, name in enumerate(["p25", "p50", "p75"])
            ]
        )
    )
    return basic.join(F.broadcast(quartiles), "column", "left")  # one row per column


def quantile_edges(df: DataFrame, columns: Sequence[str], n_bins: int = 10) -> DataFrame:
    """(column, edges): exact quantile edges, duplicates removed."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    return (
        column_quantiles(df, columns, probs)
        .groupBy("column")
        .agg(F.array_sort(F.collect_set("q")).alias("edges"))  # n_bins + 1 values at most
    )


def approx_quantile_edges(
    df: DataFrame, columns: Sequence[str], n_bins: int = 10, accuracy: int = 10_000
) -> DataFrame:
    """Cheaper edges for very large tables: one pass, bounded sketch per column."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    return _per_column(
        df,
        columns,
        edges=lambda c: F.array_sort(
            F.array_distinct(F.percentile_approx(F.col(c).cast("double"), probs, accuracy))
        ),
    )


def label_correlation(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(column, correlation): absolute Pearson correlation with the label, 0 if undefined."""

    def strength(c: str) -> Column:
        r = F.abs(F.corr(F.col(c).cast("double"), F.col(label).cast("double")))
        return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))

    return _per_column(df, columns, correlation=strength)


def top_k(df: DataFrame, name: str, strength: str, k: int = 15) -> DataFrame:
    """The k strongest features, with the out-of-fold ones marked."""
    return (
        df.orderBy(F.desc_nulls_last(strength), name)
        .limit(k)
        .withColumn("is_oof", F.lower(name).contains("oof"))
    )


def distinct_union(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct text values of one column over two tables."""
    as_text = F.col(column).cast("string").alias("value")
    return left.select(as_text).union(right.select(as_text)).distinct()


def population_shift(
    base: DataFrame, other: DataFrame, columns: Sequence[str], n_bins: int = 10
) -> DataFrame:
    """(column, psi): population stability index over the quantile bins of ``base``.

    Outer bins are open, and shares are floored at 0.0001."""
    values = column_values(base, columns).withColumn("_other", F.lit(0))
    values = values.union(column_values(other, columns).withColumn("_other", F.lit(1)))
    counts = stage(
        values.groupBy("column", "value").agg(
            F.count_if(F.col("_other") == 0).alias("base"),
            F.count_if(F.col("_other") == 1).alias("other"),
        ),
        "shift",
    )
    inner = [i / n_bins for i in range(1, n_bins)]
    edges = (
        weighted_quantiles(counts, "value", ["base"], inner, ["column"])
        .groupBy("column")
        .agg(F.array_sort(F.collect_set("q")).alias("edges"))  # n_bins - 1 values at most
    )
    place = F.size(F.filter("edges", lambda e: e < F.col("value")))
    cells = (
        counts.join(F.broadcast(edges), "column")  # one row per column
        .groupBy("column", place.alias("bin"))
        .agg(F.sum("base").alias("base"), F.sum("other").alias("other"))
    )
    totals = counts.groupBy("column").agg(F.sum("base").alias("nb"), F.sum("other").alias("no"))
    floor = F.lit(0.0001)
    p = F.greatest(F.col("base") / F.col("nb"), floor)
    q = F.greatest(F.col("other") / F.col("no"), floor)
    return (
        cells.join(F.broadcast(totals), "column")
        .groupBy("column")
        .agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    )


def group_average(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Join the average of ``value`` per group back to every row."""
    means, small = settle(df.groupBy(group).agg(F.avg(value).alias(name)))
    return lookup(df, means, [group], small)


def iqr_bounds(df: DataFrame, columns: Sequence[str], width: float = 1.5) -> dict[str, tuple]:
    """Fitted (low, high) limits per column, from exact quartiles."""
    found: dict[str, dict[int, float]] = {}
    for r in column_quantiles(df, columns, [0.25, 0.75]).collect():  # two rows per column
        found.setdefault(r["column"], {})[r["prob_index"]] = r["q"]
    return {
        c: (q[0] - width * (q[1] - q[0]), q[1] + width * (q[1] - q[0])) for c, q in found.items()
    }


def iqr_filter(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Keep rows whose values lie inside the limits; nulls are kept."""
    for c, (low, high) in bounds.items():
        df = df.where(F.col(c).isNull() | F.col(c).between(low, high))
    return df


def winsorize(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Pull values to the limits; nulls stay null."""
    return df.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
            for c, (low, high) in bounds.items()
        }
    )


def empirical_distribution(train: DataFrame, column: str) -> DataFrame:
    """(value, n): what a percentile rank is fitted on; null values are left out."""
    value = F.col(column).cast("double").alias("value")
    return train.select(value).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def percentile_rank(df: DataFrame, fitted: DataFrame, column: str, name: str) -> DataFrame:
    """Add the share of fitted rows up to the value, values tied with it counted as their mean rank. A value
    that was not fitted has the share of those below it; null stays null.

    The fitted values and those asked for are one ordered table, so neither is gathered anywhere."""
    asked = df.select(F.col(column).cast("double").alias("value")).where("value is not null").distinct()
    values = fitted.select("value", "n").union(asked.select("value", F.lit(0).cast("bigint")))
    counts = stage(values.groupBy("value").agg(F.sum("n").alias("n")), "ranks")
    total = F.broadcast(fitted.agg(F.sum("n").alias("_all")))  # one row
    ranked = running_totals(counts, "value", ["n"]).crossJoin(total)
    below = F.col("cum_n") - F.col("n")
    share = F.when(F.col("n") > 0, below + (F.col("n") + 1) / 2).otherwise(below) / F.col("_all")
    ranked = ranked.select(F.col("value").alias("_value"), share.alias(name))
    out = df.withColumn("_value", F.col(column).cast("double")).join(ranked, "_value", "left")
    return out.drop("_value")


SKETCH_K = 400  # of quantile sketches: rank error below 1 %
SKETCH_BITS = 14  # of distinct sketches: standard error 0.7 %


def profile_state(df: DataFrame, columns: Sequence[str], batch: Sequence[str] = ()) -> DataFrame:
    """(batch, column, rows, nulls, least, most, distinct, quantiles): a profile that merges. The last two are
    sketches of bounded size, so the state of a table of any size is a few kilobytes a column."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return (
        df.select(*batch, F.inline(pairs))
        .groupBy(*batch, "column")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("value").isNull()).alias("nulls"),
            F.min("value").alias("least"),
            F.max("value").alias("most"),
            F.hll_sketch_agg(F.col("value").cast("string"), SKETCH_BITS).alias("distinct"),
            F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("quantiles"),
        )
    )


def merged_state(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The states of batches as one, by ``by`` and column."""
    return states.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles", F.lit(SKETCH_K)).alias("quantiles"),
    )


def state_profile(states: DataFrame, n_bins: int = 10) -> DataFrame:
    """(column, rows, nulls, n_distinct, edges) from merged states."""
    probs = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    return states.select(
        "column",
        "rows",
        "nulls",
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
        F.array_distinct(F.kll_sketch_get_quantile_double("quantiles", probs)).alias("edges"),
    )


def state_shift(base: DataFrame, other: DataFrame, n_bins: int = 10) -> DataFrame:
    """(column, psi): the drift between two merged states, over quantile bins of ``base``; the tables
    themselves are not read. Outer bins are open, shares are floored at 0.0001."""
    inner = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    edges = F.array_distinct(F.kll_sketch_get_quantile_double("quantiles", inner))
    cuts = {r["column"]: r["e"] for r in base.select("column", edges.alias("e")).collect()}  # a row a column
    left = base.select("column", F.col("quantiles").alias("_b"))
    both = left.join(other.select("column", F.col("quantiles").alias("_o")), "column")

    def shares(sketch: str) -> Column:
        """What of the rows lies up to each edge and above the one before."""
        upto = F.array().cast("array<double>")
        for c, e in cuts.items():
            ranks = F.kll_sketch_get_rank_double(sketch, F.array(*[F.lit(float(v)) for v in e]))
            upto = F.when(F.col("column") == c, ranks).otherwise(upto)
        low, high = F.concat(F.array(F.lit(0.0)), upto), F.concat(upto, F.array(F.lit(1.0)))
        return F.zip_with(high, low, lambda a, b: F.greatest(a - b, F.lit(0.0001)))

    both = both.withColumn("_p", shares("_b")).withColumn("_q", shares("_o"))
    parts = F.zip_with("_p", "_q", lambda p, q: (q - p) * F.ln(q / p))
    return both.select("column", F.aggregate(parts, F.lit(0.0), lambda a, b: a + b).alias("psi"))
