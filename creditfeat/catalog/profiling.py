"""Profiles, rankings, set operations and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat import schemas
from creditfeat.catalog import Catalog
from creditfeat.catalog.fixtures import (
    EMPLOYMENT_TEXTS,
    applicants,
    applicants_sql,
    pick,
    split_sql,
    table,
)
from creditfeat.functions import cleaning
from creditfeat.operators import profile, quality
from creditfeat.operators.folds import with_split

CATALOG = Catalog()

NUMBERS = [
    "age",
    "annual_income",
    "loan_amount",
    "monthly_income",
    "credit_utilization",
    "debt_to_income_ratio",
    "employment_length",
    "num_login_sessions",
]


def _rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _each(columns: list[str], text: str) -> str:
    """One SELECT per column, glued with UNION ALL; ``{c}`` stands for the column."""
    return " UNION ALL ".join(text.replace("{c}", c) for c in columns)


@CATALOG.query(
    f"""WITH {applicants_sql(NUMBERS)}
    {_each(NUMBERS, '''SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean,
      round(stddev_pop({c}), 4) AS std, round(median({c}), 4) AS median,
      round(sum({c}::DOUBLE), 2) AS total FROM applicants''')}"""
)
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.summary_stats(applicants(spark, sf_dir, NUMBERS), NUMBERS)
    return _rounded(stats, ["mean", "std", "median"]).withColumn("total", F.round("total", 2))


@CATALOG.query(
    f"""WITH {applicants_sql(["default"])}
    SELECT count(*) FILTER ("default" = 0) AS negatives, count(*) FILTER ("default" = 1) AS positives,
      avg("default"::DOUBLE) AS rate,
      count(*) FILTER ("default" = 0)::DOUBLE / count(*) FILTER ("default" = 1) AS ratio
    FROM applicants"""
)
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.class_balance(applicants(spark, sf_dir, ["default"]), "default")


@CATALOG.query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@CATALOG.query(
    f"""WITH {applicants_sql()}, profile AS ({_each(
        ["monthly_income", "employment_length", "revolving_balance", "credit_utilization", "age"],
        '''SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
           (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS percent FROM applicants''')})
    SELECT * FROM profile WHERE missing > 0"""
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["monthly_income", "employment_length", "revolving_balance"]
    return profile.null_profile(applicants(spark, sf_dir, [*columns, "credit_utilization", "age"]))


@CATALOG.query(
    _each(
        ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"],
        """SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM orders""",
    )
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_counts(
        table(spark, sf_dir, "orders"),
        ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"],
    )


@CATALOG.query(
    f"""WITH {applicants_sql(NUMBERS)}
    {_each(NUMBERS, '''SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean,
      round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
      round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
      round(quantile_cont({c}, 0.75), 4) AS p75 FROM applicants''')}"""
)
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.describe_numeric(applicants(spark, sf_dir, NUMBERS), NUMBERS)
    return _rounded(stats, ["mean", "std", "p25", "p50", "p75"])


@CATALOG.query(
    f"""WITH {applicants_sql(NUMBERS)}, found AS ({_each(NUMBERS, '''SELECT '{c}' AS "column",
      list_distinct(quantile_cont({c}::DOUBLE, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))
      AS e FROM applicants''')}), flat AS (SELECT "column", unnest(list_sort(e)) AS q,
      generate_subscripts(e, 1) AS place FROM found)
    SELECT "column", place::INT AS place, round(q, 6) AS edge FROM flat"""
)
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = profile.quantile_edges(applicants(spark, sf_dir, NUMBERS), NUMBERS)
    flat = edges.select("column", F.posexplode("edges").alias("place", "edge"))
    return flat.select(
        "column", (F.col("place") + 1).alias("place"), F.round("edge", 6).alias("edge")
    )


@CATALOG.query(
    f"""WITH {applicants_sql([*NUMBERS, "default"])}
    {_each(NUMBERS, '''SELECT '{c}' AS "column",
      round(coalesce(abs(corr({c}, "default")), 0), 6) AS correlation FROM applicants''')}"""
)
def label_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, [*NUMBERS, "default"])
    return _rounded(profile.label_correlation(df, NUMBERS, "default"), ["correlation"], 6)


@CATALOG.query(
    f"""WITH {applicants_sql([*NUMBERS, "default"])}, c AS (
    {_each(NUMBERS, '''SELECT '{c}' AS "column",
      round(coalesce(abs(corr({c}, "default")), 0), 6) AS correlation FROM applicants''')})
    SELECT "column", correlation, contains(lower("column"), 'oof') AS is_oof FROM c
    ORDER BY correlation DESC, "column" LIMIT 5"""
)
def top_k_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    df = applicants(spark, sf_dir, [*NUMBERS, "default"])
    ranked = _rounded(profile.label_correlation(df, NUMBERS, "default"), ["correlation"], 6)
    return profile.top_k(ranked, "column", "correlation", 5)


@CATALOG.query("SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by key."""
    return table(spark, sf_dir, "customer").orderBy("c_custkey").limit(10)


@CATALOG.query(
    """SELECT DISTINCT cast(k AS VARCHAR) AS value
    FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)"""
)
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_union(
        table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")),
        table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")),
        "k",
    )


@CATALOG.query(
    """SELECT 'difference' AS part, k FROM (
        SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'intersection', k FROM (
        SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)"""
)
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return left.subtract(right).select(F.lit("difference").alias("part"), "k").union(
        left.intersect(right).select(F.lit("intersection"), "k")
    )


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "state", "credit_score"])}
    SELECT customer_ref, state, avg(credit_score) OVER (PARTITION BY state) AS state_score
    FROM applicants"""
)
def group_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", "state", "credit_score"])
    return profile.group_average(df, "state", "credit_score", "state_score").drop("credit_score")


_LIMITED = ["loan_amount", "monthly_income"]
_BOUNDS_SQL = f"""{applicants_sql(["customer_ref", *_LIMITED])},
    q AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b"
                            for c in _LIMITED)} FROM applicants),
    bounds AS (SELECT {", ".join(
        f"{c}_a - 0.5 * ({c}_b - {c}_a) AS {c}_low, {c}_b + 0.5 * ({c}_b - {c}_a) AS {c}_high"
        for c in _LIMITED)} FROM q)"""


@CATALOG.query(
    f"""WITH {_BOUNDS_SQL}
    SELECT customer_ref, {", ".join(_LIMITED)} FROM applicants, bounds WHERE {" AND ".join(
        f"({c} IS NULL OR {c} BETWEEN {c}_low AND {c}_high)" for c in _LIMITED)}"""
)
def iqr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", *_LIMITED])
    return profile.iqr_filter(df, profile.iqr_bounds(df, _LIMITED, 0.5))


@CATALOG.query(
    f"""WITH {_BOUNDS_SQL}
    SELECT customer_ref, {", ".join(
        f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_low), {c}_high) END, 4) AS {c}"
        for c in _LIMITED)} FROM applicants, bounds"""
)
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", *_LIMITED])
    return _rounded(profile.winsorize(df, profile.iqr_bounds(df, _LIMITED, 0.5)), _LIMITED)


_DRIFT = ["loan_amount", "age", "monthly_income"]


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "default", *_DRIFT])}, {split_sql()},
    vals AS ({_each(_DRIFT, '''SELECT '{c}' AS col, split, {c}::DOUBLE AS x FROM parted
      WHERE {c} IS NOT NULL''')}),
    edges AS (SELECT col, list_distinct(quantile_cont(x,
        [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e
      FROM vals WHERE split = 'train' GROUP BY col),
    cells AS (SELECT v.col, len(list_filter(e, lambda q: q < x)) AS bin,
        count(*) FILTER (split = 'train') AS nb, count(*) FILTER (split = 'test') AS no
      FROM vals v JOIN edges d ON v.col = d.col GROUP BY ALL),
    shares AS (SELECT col, greatest(nb / sum(nb) OVER (PARTITION BY col), 0.0001::DOUBLE) AS p,
        greatest(no / sum(no) OVER (PARTITION BY col), 0.0001::DOUBLE) AS q FROM cells)
    SELECT col AS "column", round(sum((q - p) * ln(q / p)), 6) AS psi FROM shares GROUP BY col"""
)
def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", "default", *_DRIFT])
    parted = with_split(df, "customer_ref", "default")
    train, test = (parted.where(F.col("split") == s) for s in ("train", "test"))
    return _rounded(profile.population_shift(train, test, _DRIFT), ["psi"], 6)


# -- quality checks ----------------------------------------------------------------------


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "monthly_income", "employment_length"])},
    n AS (SELECT sum((monthly_income IS NULL)::INT + (employment_length IS NULL)::INT)::BIGINT AS d
      FROM applicants)
    SELECT 'raw' AS "check", d = 0 AS passed, d AS detail FROM n
    UNION ALL SELECT 'filled', true, 0::BIGINT
    UNION ALL SELECT 'planted', count(*) = 0, count(*) FROM applicants WHERE customer_ref % 100 = 0"""
)
def check_no_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before filling, after it, and after it with an income taken away from every 100th key."""
    df = applicants(spark, sf_dir, ["customer_ref", "monthly_income", "employment_length"])
    filled = cleaning.fill_table(df)
    planted = filled.withColumn("monthly_income", F.expr("if(customer_ref % 100 = 0, null, monthly_income)"))
    return quality.run_checks(
        quality.no_nulls(df, "raw"),
        quality.no_nulls(filled, "filled"),
        quality.no_nulls(planted, "planted"),
    )


@CATALOG.query(
    """SELECT 'row_count' AS "check", a = b AS passed, b - a AS detail FROM
      (SELECT count(*) AS a FROM orders),
      (SELECT count(*) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"""
)
def check_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that is not 1:1 is found by its row count."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.same_rows(orders, orders.join(lines, "o_orderkey", "left"))


@CATALOG.query(
    """SELECT 'orders' AS "check", count(*) = 0 AS passed, count(*) AS detail
      FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
    UNION ALL SELECT 'lineitem', count(*) = 0, count(*)
      FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)"""
)
def check_key_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run_checks(
        quality.key_unique(table(spark, sf_dir, "orders"), "o_orderkey", "orders"),
        quality.key_unique(table(spark, sf_dir, "lineitem"), "l_orderkey", "lineitem"),
    )


@CATALOG.query(
    """SELECT 'quality' AS "check", d = 0 AS passed, d AS detail FROM (SELECT
        count(*) FILTER (quality IS NULL OR quality NOT IN (0, 1)) AS d FROM labels)
    UNION ALL SELECT 'embedding_label', d = 0, d FROM (SELECT
        count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS d FROM embeddings)"""
)
def check_label_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run_checks(
        quality.label_domain(table(spark, sf_dir, "labels"), "quality", "quality"),
        quality.label_domain(table(spark, sf_dir, "embeddings"), "label", "embedding_label"),
    )


@CATALOG.query(
    """SELECT 'clean' AS "check", true AS passed, 0::BIGINT AS detail
    UNION ALL SELECT 'dirty', d = 0, d FROM (SELECT count(*) AS d FROM customer
      WHERE c_custkey % 8 <> 0)
    UNION ALL SELECT 'planted', count(*) = 0, count(*) FROM customer WHERE c_custkey % 40 IN (0, 1)"""
)
def check_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before cleaning, after it, and after it with an unlisted value or null planted by key."""
    dirty = table(spark, sf_dir, "customer").selectExpr(
        f"{pick(EMPLOYMENT_TEXTS, 'c_custkey')} as employment_type"
    )
    clean = dirty.withColumn("employment_type", cleaning.employment_class())
    allowed = schemas.EMPLOYMENT_TYPES
    planted = table(spark, sf_dir, "customer").selectExpr(
        f"{pick(EMPLOYMENT_TEXTS, 'c_custkey')} as employment_type", "c_custkey"
    )
    planted = planted.withColumn("employment_type", cleaning.employment_class()).selectExpr(
        "case c_custkey % 40 when 0 then 'Unlisted' when 1 then null else employment_type end as employment_type"
    )
    return quality.run_checks(
        quality.allowed_values(planted, "employment_type", allowed, "planted"),
        quality.allowed_values(clean, "employment_type", allowed, "clean"),
        quality.allowed_values(dirty, "employment_type", allowed, "dirty"),
    )


@CATALOG.query(
    """SELECT c_mktsegment AS value, count(*) AS n FROM customer
    WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1"""
)
def unexpected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unexpected_values(
        table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]
    )


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "default"])}, {split_sql()},
    overall AS (SELECT avg("default"::DOUBLE) AS r FROM parted)
    SELECT split, count(*) FILTER ("default" = 0) AS negatives,
      count(*) FILTER ("default" = 1) AS positives, avg("default"::DOUBLE) AS rate,
      abs(avg("default"::DOUBLE) - r) <= 0.01 AS passed
    FROM parted, overall GROUP BY split, r"""
)
def check_split_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", "default"])
    return quality.split_rates(with_split(df, "customer_ref", "default"), "default")


_BASE = ["customer_ref", "monthly_income", "existing_monthly_debt", "loan_amount"]


@CATALOG.query(
    f"""WITH {applicants_sql(_BASE)},
    stored AS (SELECT a.*, o_totalprice,
        monthly_income - existing_monthly_debt + CASE WHEN customer_ref % 100 = 0 THEN 1 ELSE 0 END AS wrong
      FROM applicants a LEFT JOIN orders ON o_orderkey = customer_ref),
    bad AS (SELECT
        count(*) FILTER (wrong IS NOT NULL AND customer_ref % 100 = 0) AS derived,
        count(*) FILTER (loan_amount IS DISTINCT FROM o_totalprice) AS joined,
        count(*) FILTER (customer_ref % 50 = 0) AS one_sided FROM stored)
    SELECT 'derived' AS "check", derived = 0 AS passed, derived AS detail FROM bad
    UNION ALL SELECT 'joined', joined = 0, joined FROM bad
    UNION ALL SELECT 'one_sided', one_sided = 0, one_sided FROM bad"""
)
def check_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values against recomputed ones, over all rows. Every 100th key has a wrong derived
    value, and every 50th key has lost its loan amount on the way to the last check."""
    df = applicants(spark, sf_dir, _BASE)
    expected = F.expr("monthly_income - existing_monthly_debt")
    derived = df.withColumn(
        "disposable_income", F.expr("monthly_income - existing_monthly_debt + if(customer_ref % 100 = 0, 1, 0)")
    )
    source = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("customer_ref"), "o_totalprice"
    )
    joined = df.join(source, "customer_ref", "left")
    one_sided = joined.withColumn("loan_amount", F.expr("if(customer_ref % 50 = 0, null, loan_amount)"))
    total = F.col("o_totalprice")
    return quality.run_checks(
        quality.recomputed(derived, "disposable_income", expected, name="derived"),
        quality.recomputed(joined, "loan_amount", total, name="joined"),
        quality.recomputed(one_sided, "loan_amount", total, name="one_sided"),
    )


@CATALOG.query(
    """SELECT 'l_quantity' AS "check", typeof(min(l_quantity)) IN ('DOUBLE', 'BIGINT', 'INTEGER', 'FLOAT') AS passed,
      (typeof(min(l_quantity)) NOT IN ('DOUBLE', 'BIGINT', 'INTEGER', 'FLOAT'))::BIGINT AS detail FROM lineitem
    UNION ALL SELECT 'l_returnflag', typeof(min(l_returnflag)) IN ('DOUBLE', 'BIGINT', 'INTEGER', 'FLOAT'),
      (typeof(min(l_returnflag)) NOT IN ('DOUBLE', 'BIGINT', 'INTEGER', 'FLOAT'))::BIGINT FROM lineitem
    UNION ALL SELECT 'values', count(*) = count(l_quantity), count(*) - count(l_quantity) FROM lineitem"""
)
def check_numeric_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns are numeric, and whether the numeric one has a value in every row."""
    lines = table(spark, sf_dir, "lineitem")
    return quality.run_checks(
        quality.numeric_type(lines, "l_quantity", "l_quantity"),
        quality.numeric_type(lines, "l_returnflag", "l_returnflag"),
        quality.no_nulls(lines.select("l_quantity"), "values"),
    )
