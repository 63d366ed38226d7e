"""Category and scale encoders, full-fit and out of fold.

The statistics of "all folds but f" are the totals minus those of fold f, so one
aggregation serves every fold and every column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditfeat.operators.ordering import running_totals
from creditfeat.staging import lookup, settle, settle_columns, stage

SMOOTHING = 10.0


def _category_pairs(columns: Sequence[str]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category"))
            for c in columns
        ]
    )


def smoothed_mean(total: Column, rows: Column, prior: Column, smoothing: float) -> Column:
    """Category mean pulled towards ``prior`` by ``smoothing`` pseudo-rows."""
    return (total + prior * F.lit(float(smoothing))) / (rows + F.lit(float(smoothing)))


def category_means(
    df: DataFrame, column: str, label: str, smoothing: float = SMOOTHING
) -> DataFrame:
    """(category, n, positives, encoding) of one column over all rows."""
    prior = df.agg((F.sum(label) / F.count(label)).alias("_prior"))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("category"))
        .agg(F.count(label).alias("n"), F.sum(label).cast("long").alias("positives"))
        .crossJoin(F.broadcast(prior))  # one row
        .withColumn(
            "encoding",
            smoothed_mean(F.col("positives"), F.col("n"), F.col("_prior"), smoothing),
        )
        .drop("_prior")
    )


@dataclass
class TargetEncoder:
    """Fitted target encodings.

    ``table`` has one row per (column, category): ``by_fold`` (fitted without fold f),
    and ``full`` (fitted on everything). ``fold_priors`` and ``prior`` are the label
    means that unseen categories get.
    """

    columns: list[str]
    table: DataFrame
    small: bool
    fold_priors: list[float]
    prior: float

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        columns: Sequence[str],
        label: str,
        fold: str | None = None,
        n_folds: int = 5,
        smoothing: float = SMOOTHING,
    ) -> TargetEncoder:
        folds = range(n_folds if fold else 0)
        by_fold = [
            agg.alias(f"{kind}{f}")
            for f in folds
            for kind, agg in (
                ("n", F.count(F.when(F.col(fold) != f, F.col(label)))),
                ("s", F.coalesce(F.sum(F.when(F.col(fold) != f, F.col(label))), F.lit(0))),
            )
        ]
        everything = [F.count(label).alias("n"), F.sum(label).alias("s"), *by_fold]
        totals = df.agg(*everything).first()
        # Without labels, or with none outside a fold, there is no rate to go by but 0 or that of all.
        prior = totals["s"] / totals["n"] if totals["n"] else 0.0
        fold_priors = [totals[f"s{f}"] / totals[f"n{f}"] if totals[f"n{f}"] else prior for f in folds]

        stats = (
            df.select(F.inline(_category_pairs(columns)), label, *([fold] if fold else []))
            .where(F.col("category").isNotNull())
            .groupBy("column", "category")
            .agg(*everything)
        )
        encodings = [
            F.when(
                F.col(f"n{f}") > 0,
                smoothed_mean(F.col(f"s{f}"), F.col(f"n{f}"), F.lit(fold_priors[f]), smoothing),
            ).otherwise(F.lit(fold_priors[f]))
            for f in folds
        ]
        table = stats.select(
            "column",
            "category",
            smoothed_mean(F.col("s"), F.col("n"), F.lit(prior), smoothing).alias("full"),
            F.array(*encodings).cast("array<double>").alias("by_fold"),
        )
        table, small = settle(table)
        return cls(list(columns), table, small, fold_priors, prior)

    def transform(
        self, df: DataFrame, mode: str, fold: str = "fold", suffix: str = "_target_oof"
    ) -> DataFrame:
        """Add ``<column><suffix>``.

        mode 'oof': a row gets the encoding fitted without its own fold;
        'fold_mean': the mean of all fold encodings (held-out rows);
        'full_fit': the encoding fitted on all training rows (new rows).
        """
        priors = F.array(*[F.lit(p) for p in self.fold_priors]).cast("array<double>")
        for c in self.columns:
            own = self.table.where(F.col("column") == c).select(
                F.col("category").alias("_category"), "full", "by_fold"
            )
            df = lookup(
                df.withColumn("_category", F.col(c).cast("string")), own, ["_category"], self.small
            )
            if mode == "oof":
                value = F.coalesce(F.col("by_fold")[F.col(fold)], priors[F.col(fold)])
            elif mode == "fold_mean":
                terms = [
                    F.coalesce(F.col("by_fold")[f], F.lit(p)) for f, p in enumerate(self.fold_priors)
                ]
                value = sum(terms[1:], terms[0]) / F.lit(float(len(terms)))
            elif mode == "full_fit":
                value = F.coalesce(F.col("full"), F.lit(self.prior))
            else:
                raise ValueError(f"unknown mode {mode!r}")
            df = df.withColumn(c + suffix, value).drop("_category", "full", "by_fold")
        return df


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category, code): codes 0 … n-1 in text order for every column."""
    values = df.select(F.inline(_category_pairs(columns))).where(F.col("category").isNotNull())
    values = stage(values.distinct().withColumn("one", F.lit(1)), "categories")
    ranked = running_totals(values, "category", ["one"], ["column"])
    return ranked.select("column", "category", (F.col("cum_one") - 1).cast("int").alias("code"))


@dataclass
class LabelEncoder:
    """Persisted text-order codes; a category unseen at fit time gets the code n.

    ``few`` names the columns whose categories, in ``small``, are broadcast; one column with many
    categories, in ``large``, doesn't make the rows move for all the others."""

    columns: list[str]
    small: DataFrame
    large: DataFrame | None
    few: set[str]
    sizes: dict[str, int]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> LabelEncoder:
        return cls.from_table(list(columns), label_codes(df, columns))

    @classmethod
    def from_table(cls, columns: list[str], table: DataFrame) -> LabelEncoder:
        small, large, few = settle_columns(table)
        found = cls(columns, small, large, few, {})
        counted = found.table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
        found.sizes = dict.fromkeys(columns, 0) | {r["column"]: r["n"] for r in counted}
        return found

    @property
    def table(self) -> DataFrame:
        return self.small if self.large is None else self.small.union(self.large)

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            small = c in self.few or self.large is None
            own = (self.small if small else self.large).where(F.col("column") == c).select(
                F.col("category").alias("_category"), "code"
            )
            df = lookup(
                df.withColumn("_category", F.col(c).cast("string")), own, ["_category"], small
            )
            df = df.withColumn(c, F.coalesce("code", F.lit(self.sizes[c]))).drop("_category", "code")
        return df


def scaler_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, scale) with population deviation; a constant column gets scale 1."""
    aggs = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(c).alias("mean"),
            F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("scale"),
        )
        for c in columns
    ]
    return df.agg(F.array(*aggs).alias("m")).select(F.inline("m"))


def fold_moments(
    df: DataFrame, columns: Sequence[str], fold: str | None, n_folds: int
) -> list[tuple[list[float], list[float]]]:
    """Means and scales of every column, one pair per excluded fold and last the pair over all rows."""
    aggs = []
    for f in [*range(n_folds if fold else 0), None]:
        for i, c in enumerate(columns):
            value = F.col(c).cast("double")
            value = value if f is None else F.when(F.col(fold) != f, value)
            aggs += [F.avg(value).alias(f"m{f}_{i}"), F.stddev_pop(value).alias(f"d{f}_{i}")]
    row = df.agg(*aggs).first()
    return [
        (
            [row[f"m{f}_{i}"] or 0.0 for i in range(len(columns))],
            [row[f"d{f}_{i}"] or 1.0 for i in range(len(columns))],
        )
        for f in [*range(n_folds if fold else 0), None]
    ]


def standard_scale(
    df: DataFrame, train: DataFrame, columns: Sequence[str], suffix: str = "_scaled"
) -> DataFrame:
    """Scale ``columns`` of ``df`` with the moments of ``train``."""
    means, scales = fold_moments(train, columns, None, 0)[-1]
    return df.withColumns(
        {
            c + suffix: (F.col(c) - F.lit(m)) / F.lit(s)
            for c, m, s in zip(columns, means, scales, strict=True)
        }
    )
