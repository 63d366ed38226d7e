"""Folds, splits and supervised encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat import schemas
from creditfeat.catalog import Catalog
from creditfeat.catalog.fixtures import (
    applicants,
    applicants_sql,
    folds_sql,
    labelled,
    split_and_fold,
    split_sql,
)
from creditfeat.operators import encoders, quality
from creditfeat.operators.folds import with_split
from creditfeat.operators.woe import WoeEncoder
from creditfeat.staging import stage

CATALOG = Catalog()
CATEGORIES = schemas.TARGET_ENCODED
WOE = schemas.WOE_COLUMNS


def _te_sql(column: str, fold: str | None) -> str:
    """CTEs enc_<column> (category, fold, value) and prior_<column>."""
    key = f"enc_{column}"
    if fold is None:
        return f"""
        prior AS (SELECT sum("default") * 1.0::DOUBLE / count(*) AS g FROM train),
        {key} AS (SELECT {column} AS category,
            (sum("default")::DOUBLE + g * 10.0::DOUBLE) / (count(*)::DOUBLE + 10.0::DOUBLE) AS v
          FROM train, prior WHERE {column} IS NOT NULL GROUP BY {column}, g)"""
    return f"""
    {key} AS (SELECT {column} AS category, f,
        (sum("default")::DOUBLE + g * 10.0::DOUBLE) / (count(*)::DOUBLE + 10.0::DOUBLE) AS v
      FROM train JOIN priors ON fold <> f
      WHERE {column} IS NOT NULL GROUP BY {column}, f, g)"""


_PRIORS = """
    fold_ids AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
    priors AS (SELECT f, sum("default")::DOUBLE / count(*)::DOUBLE AS g
      FROM train JOIN fold_ids ON fold <> f GROUP BY f)"""


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "default"])}, {folds_sql()}
    SELECT customer_ref, "default", fold FROM folded"""
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, []).select("customer_ref", "default", "fold")


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "default"])}, {split_sql()}
    SELECT customer_ref, "default", split FROM parted"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", "default"])
    return with_split(df, "customer_ref", "default").select("customer_ref", "default", "split")


_TE_COLUMNS = ["customer_ref", "default", *CATEGORIES]


@CATALOG.query(
    f"""WITH {applicants_sql(_TE_COLUMNS)}, {folds_sql(name="train")}, {_PRIORS},
    {", ".join(_te_sql(c, "fold") for c in CATEGORIES)}
    SELECT t.customer_ref, t."default", t.fold,
      {", ".join(f"coalesce(e_{c}.v, p.g) AS {c}_target_oof" for c in CATEGORIES)}
    FROM train t JOIN priors p ON p.f = t.fold
    {" ".join(f"LEFT JOIN enc_{c} e_{c} ON e_{c}.category = t.{c} AND e_{c}.f = t.fold"
              for c in CATEGORIES)}"""
)
def oof_target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = stage(labelled(spark, sf_dir, CATEGORIES), "folded")
    encoder = encoders.TargetEncoder.fit(train, CATEGORIES, "default", "fold")
    return encoder.transform(train, "oof").select(
        "customer_ref", "default", "fold", *[f"{c}_target_oof" for c in CATEGORIES]
    )


def _split_train(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Staged applicants with split, and folds inside the training part."""
    df = applicants(spark, sf_dir, ["customer_ref", "default", *columns])
    return stage(split_and_fold(df), "parted")


def _split_sql(columns: list[str]) -> str:
    """CTEs parted, train (with fold) and test over the applicants."""
    return f"""{applicants_sql(["customer_ref", "default", *columns])}, {split_sql()},
    pool AS (SELECT * FROM parted WHERE split = 'train'), {folds_sql("pool", "train")},
    test AS (SELECT * FROM parted WHERE split = 'test')"""


@CATALOG.query(
    f"""WITH {_split_sql(CATEGORIES)}, {_PRIORS},
    {", ".join(_te_sql(c, "fold") for c in CATEGORIES)},
    each AS (SELECT t.customer_ref, p.f,
        {", ".join(f"coalesce(e_{c}.v, p.g) AS {c}_v" for c in CATEGORIES)}
      FROM test t CROSS JOIN priors p
      {" ".join(f"LEFT JOIN enc_{c} e_{c} ON e_{c}.category = t.{c} AND e_{c}.f = p.f"
                for c in CATEGORIES)})
    SELECT customer_ref, {", ".join(f"round(avg({c}_v), 9) AS {c}_target_oof" for c in CATEGORIES)}
    FROM each GROUP BY customer_ref"""
)
def fold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows: the mean of the encodings fitted without each fold."""
    parted = _split_train(spark, sf_dir, CATEGORIES)
    train, test = (parted.where(F.col("split") == s) for s in ("train", "test"))
    encoder = encoders.TargetEncoder.fit(train, CATEGORIES, "default", "fold")
    names = [f"{c}_target_oof" for c in CATEGORIES]
    return encoder.transform(test, "fold_mean").select(
        "customer_ref", *[F.round(n, 9).alias(n) for n in names]
    )


@CATALOG.query(
    f"""WITH {_split_sql(CATEGORIES)},
    prior AS (SELECT sum("default")::DOUBLE / count(*)::DOUBLE AS g FROM train),
    {", ".join(f'''enc_{c} AS (SELECT {c} AS category,
        (sum("default")::DOUBLE + g * 10.0::DOUBLE) / (count(*)::DOUBLE + 10.0::DOUBLE) AS v
      FROM train, prior WHERE {c} IS NOT NULL GROUP BY {c}, g)''' for c in CATEGORIES)}
    SELECT t.customer_ref, {", ".join(f"coalesce(e_{c}.v, g) AS {c}_target_oof" for c in CATEGORIES)}
    FROM test t CROSS JOIN prior
    {" ".join(f"LEFT JOIN enc_{c} e_{c} ON e_{c}.category = t.{c}" for c in CATEGORIES)}"""
)
def full_target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows: encodings fitted on all training rows."""
    parted = _split_train(spark, sf_dir, CATEGORIES)
    train, test = (parted.where(F.col("split") == s) for s in ("train", "test"))
    encoder = encoders.TargetEncoder.fit(train, CATEGORIES, "default")
    return encoder.transform(test, "full_fit").select(
        "customer_ref", *[f"{c}_target_oof" for c in CATEGORIES]
    )


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "default", "state"])},
    prior AS (SELECT sum("default")::DOUBLE / count(*)::DOUBLE AS g FROM applicants)
    SELECT state AS category, count(*) AS n, sum("default")::BIGINT AS positives,
      (sum("default")::DOUBLE + g * 10.0::DOUBLE) / (count(*)::DOUBLE + 10.0::DOUBLE) AS encoding
    FROM applicants, prior GROUP BY state, g"""
)
def category_smoothed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["default", "state"])
    return encoders.category_means(df, "state", "default")


_DECILES = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


def _woe_sql(columns: list[str], source: str, folds: bool, zero: bool = False) -> str:
    """CTEs vals, edges and woe (column, f, bin, lower, upper, good, bad, woe)."""
    pick = (lambda c: f"coalesce({c}, 0)") if zero else (lambda c: c)
    vals = " UNION ALL ".join(
        f"SELECT customer_ref, \"default\", {'fold' if folds else '-2'} AS fold, "
        f"'{c}' AS col, {pick(c)}::DOUBLE AS x FROM {source}"
        for c in columns
    )
    ids = "[0, 1, 2, 3, 4]" if folds else "[-1]"
    return f"""
    fids AS (SELECT unnest({ids}) AS f),
    vals AS ({vals}),
    edges AS (SELECT col, f, list_sort(list_distinct(quantile_cont(x, {_DECILES}))) AS e
      FROM vals JOIN fids ON fold <> f WHERE x IS NOT NULL GROUP BY col, f),
    totals AS (SELECT f, count(*) FILTER ("default" = 0) AS tg, count(*) FILTER ("default" = 1) AS tb
      FROM {source} JOIN fids ON {'fold <> f' if folds else 'true'} GROUP BY f),
    bins AS (SELECT col, f, e, unnest(range(1, len(e))) AS bin FROM edges),
    hits AS (SELECT v.col, d.f,
        CASE WHEN x = e[1] THEN 1 ELSE len(list_filter(e, lambda q: q < x)) END AS bin,
        count(*) FILTER ("default" = 0) AS good, count(*) FILTER ("default" = 1) AS bad
      FROM vals v JOIN edges d ON v.col = d.col AND v.fold <> d.f
      WHERE x BETWEEN e[1] AND e[len(e)] GROUP BY ALL),
    woe AS (SELECT b.col, b.f, b.bin, e[b.bin] AS lower, e[b.bin + 1] AS upper,
        coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
        ln((greatest(coalesce(good, 0), 0.5::DOUBLE) / tg)
         / (greatest(coalesce(bad, 0), 0.5::DOUBLE) / tb)) AS woe
      FROM bins b JOIN totals t ON t.f = b.f
      LEFT JOIN hits h ON h.col = b.col AND h.f = b.f AND h.bin = b.bin)"""


def _woe_lookup(column: str, rows: str, fold: str) -> str:
    """Scalar subquery: WOE of a row's value, 0 outside the bins."""
    return f"""coalesce((SELECT max(w.woe) FROM woe w WHERE w.col = '{column}' AND w.f = {fold}
      AND ({rows}.{column} > w.lower OR ({rows}.{column} = w.lower AND w.bin = 1))
      AND {rows}.{column} <= w.upper), 0.0)"""


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "default", *WOE])}, {folds_sql(name="train")},
    {_woe_sql(WOE, "train", True)}
    SELECT customer_ref, fold,
      {", ".join(f"round({_woe_lookup(c, 't', 't.fold')}, 6) AS {c}_woe_oof" for c in WOE)}
    FROM train t"""
)
def oof_woe(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = stage(labelled(spark, sf_dir, WOE), "folded")
    encoder = WoeEncoder.fit(train, WOE, "default", "fold")
    return encoder.transform(train, "oof").select(
        "customer_ref", "fold", *[F.round(f"{c}_woe_oof", 6).alias(f"{c}_woe_oof") for c in WOE]
    )


@CATALOG.query(
    f"""WITH {_split_sql(WOE)}, {_woe_sql(WOE, "train", False, zero=True)},
    fresh AS (SELECT customer_ref, {", ".join(f"coalesce({c}, 0) AS {c}" for c in WOE)} FROM test)
    SELECT customer_ref,
      {", ".join(f"round({_woe_lookup(c, 't', '-1')}, 6) AS {c}_woe_oof" for c in WOE)}
    FROM fresh t"""
)
def full_woe(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = _split_train(spark, sf_dir, WOE)
    train, test = (parted.where(F.col("split") == s) for s in ("train", "test"))
    encoder = WoeEncoder.fit(train, WOE, "default", nulls_as_zero=True)
    return encoder.transform(test, "full_fit").select(
        "customer_ref", *[F.round(f"{c}_woe_oof", 6).alias(f"{c}_woe_oof") for c in WOE]
    )


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "default", *WOE])}, {_woe_sql(WOE, "applicants", False)}
    SELECT col AS "column", bin::INT AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper,
      good, bad, round(woe, 6) AS woe FROM woe"""
)
def woe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["default", *WOE])
    fitted = WoeEncoder.fit(df, WOE, "default").table(spark)
    return fitted.select(
        "column",
        "bin",
        F.round("lower", 6).alias("lower"),
        F.round("upper", 6).alias("upper"),
        "good",
        "bad",
        F.round("woe", 6).alias("woe"),
    )


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", *CATEGORIES])},
    {", ".join(f'''codes_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
      FROM (SELECT DISTINCT {c} AS v FROM applicants WHERE {c} IS NOT NULL))''' for c in CATEGORIES)}
    SELECT customer_ref, {", ".join(f"k_{c}.code::INT AS {c}" for c in CATEGORIES)} FROM applicants
    {" ".join(f"LEFT JOIN codes_{c} k_{c} ON k_{c}.v = {c}" for c in CATEGORIES)}"""
)
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", *CATEGORIES])
    return encoders.LabelEncoder.fit(df, CATEGORIES).transform(df)


_SCALED = ["loan_amount", "annual_income", "monthly_income", "age"]


@CATALOG.query(
    f"""WITH {_split_sql(_SCALED)},
    moments AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in _SCALED)}
      FROM train)
    SELECT customer_ref, {", ".join(
        f"round(({c} - m_{c}) / coalesce(nullif(d_{c}, 0), 1), 6) AS {c}_scaled" for c in _SCALED)}
    FROM test, moments"""
)
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = _split_train(spark, sf_dir, _SCALED)
    train, test = (parted.where(F.col("split") == s) for s in ("train", "test"))
    scaled = encoders.standard_scale(test, train, _SCALED)
    return scaled.select(
        "customer_ref", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in _SCALED]
    )


@CATALOG.query(
    f"""WITH {applicants_sql(_SCALED)}
    {" UNION ALL ".join(f'''SELECT '{c}' AS "column", round(avg({c}), 4) AS mean,
      round(coalesce(nullif(stddev_pop({c}), 0), 1), 4) AS scale FROM applicants''' for c in _SCALED)}"""
)
def scaler_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, _SCALED)
    return encoders.scaler_moments(df, _SCALED).select(
        "column", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale")
    )


@CATALOG.query(
    f"""WITH {applicants_sql(_TE_COLUMNS)}, {folds_sql(name="train")}, {_PRIORS},
    {", ".join(_te_sql(c, "fold") for c in CATEGORIES)},
    prior AS (SELECT sum("default")::DOUBLE / count(*)::DOUBLE AS g FROM train),
    {", ".join(f'''own_{c} AS (SELECT {c} AS category,
        (sum("default")::DOUBLE + g * 10.0::DOUBLE) / (count(*)::DOUBLE + 10.0::DOUBLE) AS v
      FROM train, prior WHERE {c} IS NOT NULL GROUP BY {c}, g)''' for c in CATEGORIES)},
    wide AS (SELECT t."default" AS y,
        {", ".join(f"coalesce(e_{c}.v, p.g) AS oof_{c}, coalesce(o_{c}.v, r.g) AS own_{c}"
                   for c in CATEGORIES)}
      FROM train t JOIN priors p ON p.f = t.fold CROSS JOIN prior r
      {" ".join(f'''LEFT JOIN enc_{c} e_{c} ON e_{c}.category = t.{c} AND e_{c}.f = t.fold
                LEFT JOIN own_{c} o_{c} ON o_{c}.category = t.{c}''' for c in CATEGORIES)})
    {" UNION ALL ".join(f'''SELECT '{c}' AS feature,
      round(abs(corr(oof_{c}, y)), 6) AS oof_correlation,
      round(abs(corr(own_{c}, y)), 6) AS in_sample_correlation,
      abs(corr(oof_{c}, y)) > 0.9 AS suspicious FROM wide''' for c in CATEGORIES)}"""
)
def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation with the label of out-of-fold against in-sample encodings."""
    train = stage(labelled(spark, sf_dir, CATEGORIES), "folded")
    encoder = encoders.TargetEncoder.fit(train, CATEGORIES, "default", "fold")
    both = encoder.transform(
        encoder.transform(train, "oof", suffix="_oof"), "full_fit", suffix="_own"
    )
    report = quality.leak_report(
        both, [(c, f"{c}_oof", f"{c}_own") for c in CATEGORIES], "default"
    )
    return _rounded_report(report)


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "default", *WOE])}, {folds_sql(name="train")},
    outside AS (WITH {_woe_sql(WOE, "train", True)} SELECT customer_ref, "default" AS y,
      {", ".join(f"{_woe_lookup(c, 't', 't.fold')} AS oof_{c}" for c in WOE)} FROM train t),
    inside AS (WITH {_woe_sql(WOE, "train", False)} SELECT customer_ref,
      {", ".join(f"{_woe_lookup(c, 't', '-1')} AS own_{c}" for c in WOE)} FROM train t),
    wide AS (SELECT * FROM outside JOIN inside USING (customer_ref))
    {" UNION ALL ".join(f'''SELECT '{c}' AS feature, round(coalesce(abs(corr(oof_{c}, y)), 0), 6) AS oof_correlation,
      round(coalesce(abs(corr(own_{c}, y)), 0), 6) AS in_sample_correlation,
      coalesce(abs(corr(oof_{c}, y)), 0) > 0.9 AS suspicious FROM wide''' for c in WOE)}"""
)
def leak_report_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for weights of evidence."""
    train = stage(labelled(spark, sf_dir, WOE), "folded")
    encoder = WoeEncoder.fit(train, WOE, "default", "fold")
    both = encoder.transform(encoder.transform(train, "oof", suffix="_oof"), "full_fit", suffix="_own")
    report = quality.leak_report(both, [(c, f"{c}_oof", f"{c}_own") for c in WOE], "default")
    return _rounded_report(report)


def _rounded_report(report: DataFrame) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("oof_correlation", "in_sample_correlation")]
    return report.select("feature", *rounded, "suspicious")
