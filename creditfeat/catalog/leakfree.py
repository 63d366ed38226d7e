"""The whole feature graph, fitted on training rows: from six raw tables to the leak-free table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat import schemas
from creditfeat.catalog import Catalog
from creditfeat.catalog.encoding import _PRIORS, _te_sql, _woe_lookup, _woe_sql
from creditfeat.catalog.fixtures import applicants, applicants_sql, folds_sql, raw_sources, split_sql
from creditfeat.catalog.preparing import _ALL_SQL, _RATIO_SQL
from creditfeat.operators import profile, quality
from creditfeat.operators.folds import with_folds, with_split
from creditfeat.plans.features import FeatureFit
from creditfeat.plans.preparation import clean_sources, merge_sources
from creditfeat.staging import stage

CATALOG = Catalog()
KEY, LABEL = schemas.KEY, schemas.LABEL
CATEGORIES, WOE, POLY = schemas.TARGET_ENCODED, schemas.WOE_COLUMNS, schemas.POLYNOMIAL_COLUMNS

_INPUTS = ["debt_to_income_ratio", "credit_utilization", "age", "credit_score", "employment_length", "monthly_income"]
_LATER = {
    "debt_credit_interaction": "debt_to_income_ratio * credit_utilization",
    "age_credit_interaction": "age * credit_score / 100",
    "employment_income_stability": "employment_length * monthly_income",
    **{f"{c}_squared": f"{c} * {c}" for c in POLY},
}
_MADE = [*_RATIO_SQL, "digital_engagement_score"]
_NUMBERS = [*_INPUTS, *_MADE]

# What is fitted (the largest session count, folds, encodings, bins, codes) is fitted on training rows.
_TABLES = f"""{applicants_sql()},
    merged AS (SELECT {", ".join(f'{e} AS "{n}"' for n, e in _ALL_SQL.items())} FROM applicants),
    {split_sql("merged")},
    top AS (SELECT max(num_login_sessions)::DOUBLE AS top_sessions FROM parted WHERE split = 'train'),
    derived AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _RATIO_SQL.items())},
        has_mobile_app * 0.5::DOUBLE + paperless_billing * 0.3::DOUBLE
        + num_login_sessions / top_sessions * 0.2::DOUBLE AS digital_engagement_score
      FROM parted, top),
    filled AS (SELECT customer_ref, "default", split, {", ".join(CATEGORIES)},
        {", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in _NUMBERS)} FROM derived),
    wide AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _LATER.items())} FROM filled),
    pool AS (SELECT * FROM wide WHERE split = 'train'), {folds_sql("pool", "train")},
    test AS (SELECT * FROM wide WHERE split = 'test'), {_PRIORS},
    {", ".join(_te_sql(c, "fold") for c in CATEGORIES)}, {_woe_sql(WOE, "train", True)},
    {", ".join(f'''codes_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
      FROM (SELECT DISTINCT {c} AS v FROM train))''' for c in CATEGORIES)}"""
_CODES = " ".join(f"LEFT JOIN codes_{c} k_{c} ON k_{c}.v = t.{c}" for c in CATEGORIES)
_PLAIN = ", ".join(f"t.{c}" for c in [*_NUMBERS, *_LATER])
_CODED = ", ".join(
    f"coalesce(k_{c}.code, (SELECT count(*) FROM codes_{c}))::DOUBLE AS {c}" for c in CATEGORIES
)


def _selected(df: DataFrame, *first: str) -> DataFrame:
    plain = [F.col(c).cast("double").alias(c) for c in [*_NUMBERS, *_LATER, *CATEGORIES]]
    encoded = [F.round(f"{c}_target_oof", 9).alias(f"{c}_target_oof") for c in CATEGORIES]
    evidence = [F.round(f"{c}_woe_oof", 6).alias(f"{c}_woe_oof") for c in WOE]
    return df.select(*first, *plain, *encoded, *evidence)


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[FeatureFit, DataFrame, DataFrame]:
    """The graph without neighbour rates, the training rows with their features, and the held-out rows."""
    sources = clean_sources(raw_sources(spark, sf_dir))
    # Split and folds go by key and label alone, so the narrow anchor gets them and the wide rows don't move.
    sources["application_metadata"] = _parted(sources["application_metadata"])
    merged = stage(merge_sources(sources), "merged")
    train, test = merged.where("split = 'train'").drop("split"), merged.where("split = 'test'").drop("fold")
    fitted, train = FeatureFit.fit(train, ks=(), has_folds=True)
    return fitted, train, test


def _parted(anchor: DataFrame) -> DataFrame:
    """The anchor with its split, and the folds of the training rows (else null). Folds are those of the rows
    as the features see them, where nulls are filled."""
    parted = stage(with_split(anchor, KEY, LABEL), "parted")
    train = parted.where("split = 'train'")
    own = train.select(*parted.columns, *[F.col(c).alias(f"_{c}") for c in (KEY, LABEL)]).na.fill(0, [f"_{KEY}", f"_{LABEL}"])
    folded = with_folds(own, f"_{KEY}", f"_{LABEL}").select(*parted.columns, "fold")
    return folded.unionByName(parted.where("split = 'test'"), allowMissingColumns=True)


@CATALOG.query(
    f"""WITH {_TABLES}
    SELECT t.customer_ref, t."default", t.fold, {_PLAIN}, {_CODED},
      {", ".join(f"round(coalesce(e_{c}.v, p.g), 9) AS {c}_target_oof" for c in CATEGORIES)},
      {", ".join(f"round({_woe_lookup(c, 't', 't.fold')}, 6) AS {c}_woe_oof" for c in WOE)}
    FROM train t JOIN priors p ON p.f = t.fold {_CODES}
    {" ".join(f"LEFT JOIN enc_{c} e_{c} ON e_{c}.category = t.{c} AND e_{c}.f = t.fold" for c in CATEGORIES)}"""
)
def leak_free_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with every feature that SQL can give, none of which has seen the row's label. The
    neighbour rates are compared in ``oof_knn``."""
    return _selected(_fitted(spark, sf_dir)[1], KEY, LABEL, "fold")


@CATALOG.query(
    f"""WITH {_TABLES},
    each AS (SELECT t.customer_ref, {", ".join(f"avg(coalesce(e_{c}.v, p.g)) AS {c}_v" for c in CATEGORIES)}
      FROM test t CROSS JOIN priors p
      {" ".join(f"LEFT JOIN enc_{c} e_{c} ON e_{c}.category = t.{c} AND e_{c}.f = p.f" for c in CATEGORIES)}
      GROUP BY t.customer_ref)
    SELECT t.customer_ref, {_PLAIN}, {_CODED},
      {", ".join(f"round({c}_v, 9) AS {c}_target_oof" for c in CATEGORIES)},
      {", ".join(
          f"round(({' + '.join(_woe_lookup(c, 't', str(f)) for f in range(5))}) / 5.0::DOUBLE, 6) AS {c}_woe_oof"
          for c in WOE)}
    FROM test t JOIN each USING (customer_ref) {_CODES}"""
)
def leak_free_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows by the means of the fits that leave out one fold."""
    fitted, _, test = _fitted(spark, sf_dir)
    return _selected(fitted.transform(test.drop(LABEL), "fold_mean"), KEY)


_RANKED = ["loan_amount", "credit_score", "revolving_balance"]


@CATALOG.query(
    f"""WITH {applicants_sql([KEY, LABEL, *_RANKED])}, {split_sql()},
    {", ".join(f'''fit_{c} AS (SELECT {c}::DOUBLE AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY {c}) AS upto,
        sum(count(*)) OVER () AS total FROM parted WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c})'''
        for c in _RANKED)}
    SELECT customer_ref, split, {", ".join(f'''round(CASE
        WHEN {c} IS NULL THEN NULL
        WHEN f_{c}.v = {c} THEN (f_{c}.upto - f_{c}.n + (f_{c}.n + 1) / 2) / f_{c}.total
        ELSE coalesce(f_{c}.upto, 0) / (SELECT max(total) FROM fit_{c}) END, 9) AS {c}_rank''' for c in _RANKED)}
    FROM parted {" ".join(f"ASOF LEFT JOIN fit_{c} f_{c} ON {c} >= f_{c}.v" for c in _RANKED)}"""
)
def percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks among the training rows, for training and held-out rows."""
    df = stage(with_split(applicants(spark, sf_dir, [KEY, LABEL, *_RANKED]), KEY, LABEL), "parted")
    train, out = df.where("split = 'train'"), df
    for c in _RANKED:
        fitted = stage(profile.empirical_distribution(train, c), "distribution")
        out = profile.percentile_rank(out, fitted, c, f"{c}_rank")
    return out.select(KEY, "split", *[F.round(f"{c}_rank", 9).alias(f"{c}_rank") for c in _RANKED])


_PROFILED = ["loan_amount", "annual_income", "credit_score", "age", "revolving_balance"]


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept state of twelve batches, by the month in which the orders were placed."""
    df = applicants(spark, sf_dir, [*_PROFILED, "num_customer_service_calls"])
    df = df.withColumnRenamed("num_customer_service_calls", "month")
    return stage(profile.profile_state(df, _PROFILED, ["month"]), "state")


@CATALOG.query()
def mergeable_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the whole table merged from the kept states of its batches, without the table.
    Sketches have error bounds and no SQL twin; the exact forms are ``distinct_counts`` and
    ``quantile_edges``."""
    return profile.state_profile(profile.merged_state(_states(spark, sf_dir)))


@CATALOG.query()
def mergeable_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the second half of the year against the first, from kept states; the exact form is
    ``drift_psi``."""
    halves = profile.merged_state(
        _states(spark, sf_dir).withColumn("half", F.when(F.col("month") <= 6, 1).otherwise(2)), ["half"]
    )
    halves = stage(halves, "halves")
    return profile.state_shift(halves.where("half = 1"), halves.where("half = 2"))


@CATALOG.query(
    f"""WITH {applicants_sql([KEY, LABEL, "credit_score"])}
    SELECT count(*) AS "rows", 0::BIGINT AS "nulls", 0::BIGINT AS bad_labels,
      sum("default")::BIGINT AS positives FROM applicants"""
)
def checks_while_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, label and row-count checks observed by the job that writes a table."""
    df = applicants(spark, sf_dir, [KEY, LABEL, "credit_score"])
    _, seen = quality.staged_with_checks(df, "applicants", [KEY, "credit_score"], LABEL)
    row = [(seen["rows"], seen["nulls"], seen["bad_labels"], seen["positives"])]
    return spark.createDataFrame(row, "rows bigint, nulls bigint, bad_labels bigint, positives bigint")
