"""Views over the driver's tables that play the role of the applicant data.

One applicant is one order. Money is summed in integer cents, so every input is the
same double in every engine and whatever the order of the sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat import schemas
from creditfeat.operators.folds import with_folds, with_split
from creditfeat.staging import stage

# Aggregates of an order's lines.
LINES = {
    "n_lines": "count(*)",
    "cents": "cast(sum(cast(round(l_extendedprice * 1e2) as bigint)) as bigint)",
    "top_cents": "max(cast(round(l_extendedprice * 1e2) as bigint))",
    "tax_parts": "cast(sum(cast(round(l_extendedprice * 1e2) as bigint)"
    " * cast(round(l_tax * 1e2) as bigint)) as bigint)",
    "disc_points": "cast(sum(cast(round(l_discount * 1e2) as bigint)) as bigint)",
    "qty": "cast(sum(cast(l_quantity as bigint)) as bigint)",
    "n_returned": "cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint)",
    "n_open": "cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as bigint)",
}

# Domain column -> expression over orders, customer, nation, region and LINES.
APPLICANT = {
    "customer_ref": "o_orderkey",
    "default": "cast(case when o_orderstatus = 'F' then 1 else 0 end as int)",
    "state": "n_name",
    "education": "o_orderpriority",
    "employment_type": "c_mktsegment",
    "marital_status": "r_name",
    "age": "cast(18 + o_custkey % 60 as int)",
    "num_dependents": "cast(o_orderkey % 4 as int)",
    "employment_length": "case when o_orderkey % 20 = 7 then null else (o_orderkey % 40) * 1e0 end",
    "annual_income": "c_acctbal",
    "loan_amount": "o_totalprice",
    "loan_term": "cast(12 * (1 + o_orderkey % 5) as int)",
    "interest_rate": "disc_points * 1e0",
    "collateral_value": "cents / 1e2",
    "monthly_income": "cents / 1e2",
    "existing_monthly_debt": "tax_parts / 1e4",
    "monthly_payment": "top_cents / 1e2",
    "revolving_balance": "case when o_orderkey % 37 = 5 then null else qty * 1e1 end",
    "available_credit": "top_cents / 1e2",
    "credit_usage_amount": "qty * 1e1",
    "total_monthly_debt_payment": "(tax_parts + top_cents * 100) / 1e4",
    "total_debt_amount": "qty * 1e2",
    "monthly_free_cash_flow": "(cents - top_cents) / 1e2",
    "debt_to_income_ratio": "(tax_parts / 1e4) / (cents / 1e2)",
    "debt_service_ratio": "(top_cents / 1e2) / (cents / 1e2)",
    "payment_to_income_ratio": "(top_cents / 1e2) / (cents / 1e2)",
    "credit_utilization": "(disc_points / 1e2) / n_lines",
    "credit_score": "300e0 + o_custkey % 551",
    "num_credit_accounts": "n_lines * 1e0",
    "total_credit_limit": "c_acctbal * 1e1",
    "oldest_account_age_months": "((2025 - year(o_orderdate)) * 12 + month(o_orderdate)) * 1e0",
    "num_delinquencies_2yrs": "n_returned * 1e0",
    "num_public_records": "(o_orderkey % 3) * 1e0",
    "num_collections": "(o_orderkey % 5) * 1e0",
    "num_inquiries_6mo": "n_open * 1e0",
    "recent_inquiry_count": "(o_custkey % 7) * 1e0",
    "oldest_credit_line_age": "((2025 - year(o_orderdate)) * 12) * 1e0",
    "regional_unemployment_rate": "n_nationkey / 1e1 + r_regionkey",
    "regional_median_income": "(n_nationkey + 1) * 1e3",
    "regional_median_rent": "(r_regionkey + 1) * 1e2",
    "housing_price_index": "90e0 + r_regionkey * 5",
    "cost_of_living_index": "80e0 + n_nationkey",
    "num_login_sessions": "cast(qty as int)",
    "num_customer_service_calls": "cast(month(o_orderdate) as int)",
    "has_mobile_app": "cast(o_custkey % 2 as int)",
    "paperless_billing": "cast(o_orderkey % 2 as int)",
    "application_hour": "cast(o_orderkey % 24 as int)",
    "application_day_of_week": "cast(o_orderkey % 7 + 1 as int)",
    "account_open_year": "cast(year(o_orderdate) as int)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _needs(text: str, *prefixes: str) -> bool:
    return any(p in text for p in prefixes)


def applicants(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """The wide applicant table; only the joins that ``columns`` need are made."""
    columns = list(columns or APPLICANT)
    text = " ".join(APPLICANT[c] for c in columns)
    df = table(spark, sf_dir, "orders")
    if any(name in text for name in LINES):
        lines = (
            table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(*[F.expr(e).alias(n) for n, e in LINES.items() if n in text])
        )
        df = df.join(lines, "o_orderkey", "left")
    if _needs(text, "c_", "n_name", "n_nationkey", "r_"):
        customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
        df = df.join(customer, "o_custkey", "left")
    if _needs(text, "n_name", "n_nationkey", "r_name", "r_regionkey"):
        # 25 and 5 rows at every scale.
        nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
        region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
        place = nation.join(region, "n_regionkey", "left")
        df = df.join(F.broadcast(place), "c_nationkey", "left")
        df = df.withColumns(
            {"n_nationkey": F.col("c_nationkey"), "r_regionkey": F.col("n_regionkey")}
        )
    return df.selectExpr(*[f"{APPLICANT[c]} as `{c}`" for c in columns])


def applicants_sql(columns: Sequence[str] | None = None) -> str:
    """The same view for the oracle, as a common table expression named ``applicants``."""
    columns = list(columns or APPLICANT)
    items = ", ".join(f'{APPLICANT[c]} AS "{c}"' for c in columns)
    lines = ", ".join(f"{e} AS {n}" for n, e in LINES.items())
    return f"""
    lines AS (SELECT l_orderkey, {lines} FROM lineitem GROUP BY l_orderkey),
    applicants AS (
      SELECT {items} FROM orders
      LEFT JOIN customer ON o_custkey = c_custkey
      LEFT JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey
      LEFT JOIN lines ON o_orderkey = l_orderkey)"""


def labelled(
    spark: SparkSession, sf_dir: str, columns: Sequence[str], folds: bool = True
) -> DataFrame:
    """Key, label, ``columns``, and a stratified fold."""
    df = applicants(spark, sf_dir, ["customer_ref", "default", *columns])
    return with_folds(df, "customer_ref", "default") if folds else df


def split_and_fold(df: DataFrame) -> DataFrame:
    """Add the split, and a fold for the rows of the training part (null for test rows)."""
    parted = with_split(df, schemas.KEY, schemas.LABEL)
    train = with_folds(parted.where("split = 'train'"), schemas.KEY, schemas.LABEL)
    test = parted.where("split = 'test'").withColumn("fold", F.lit(None).cast("int"))
    return train.unionByName(test)


# Oracle twins of the fold and split rules, over a relation with customer_ref and default.
SHUFFLED = "md5(cast(customer_ref AS VARCHAR) || ':42')"


def folds_sql(source: str = "applicants", name: str = "folded") -> str:
    return f"""{name} AS (
      SELECT *, cast((row_number() OVER (
          PARTITION BY "default" ORDER BY {SHUFFLED}, customer_ref) - 1) % 5 AS INT) AS fold
      FROM {source})"""


def split_sql(source: str = "applicants", name: str = "parted") -> str:
    return f"""{name} AS (
      SELECT *, CASE WHEN row_number() OVER (
          PARTITION BY "default" ORDER BY {SHUFFLED}, customer_ref)
          <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY "default"))
        THEN 'test' ELSE 'train' END AS split
      FROM {source})"""


# Dirty spellings planted in the raw tables; the oracle uses the clean class directly.
EMPLOYMENT_TEXTS = [
    "Full-time",
    "FULL_TIME",
    "FT",
    "PART_TIME",
    "Pt",
    "SELF_EMPLOYED",
    "Contract",
    "retired",
]
LOAN_TEXTS = [
    "personal loan",
    "HOME_LOAN",
    "home mortgage",
    "CC",
    "Credit Card",
    "Car Loan",
    "AUTO_LOAN",
    "boat",
]


def pick(texts: Sequence[str], number: str) -> str:
    """SQL: the text at position ``number`` modulo the list."""
    cases = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts))
    return f"CASE cast({number} % {len(texts)} AS INT) {cases} END"


def raw_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six source tables in raw form: money as text, dirty categories, text numbers."""
    a = stage(applicants(spark, sf_dir), "applicants")

    def money_text(c: str) -> str:
        return f"concat('$', format_number({c}, 4)) as {c}"

    return {
        "application_metadata": a.selectExpr(
            "customer_ref",
            "`default`",
            "concat('A', customer_ref) as application_id",
            "application_hour",
            "application_day_of_week",
            "account_open_year",
            "'OK' as account_status_code",
            "case when has_mobile_app = 1 then 'app' else 'mail' end as preferred_contact",
            "concat('R', customer_ref % 10) as referral_code",
            "num_login_sessions",
            "num_customer_service_calls",
            "has_mobile_app",
            "paperless_billing",
            "customer_ref * 1e-3 as random_noise_1",
        ),
        "demographics": a.selectExpr(
            "customer_ref as cust_id",
            "age",
            "marital_status",
            "num_dependents",
            "education",
            f"{pick(EMPLOYMENT_TEXTS, 'age')} as employment_type",
            "employment_length",
            money_text("annual_income"),
        ),
        "credit_history": a.selectExpr(
            "customer_ref as customer_number",
            "credit_score",
            "num_credit_accounts",
            "total_credit_limit",
            "oldest_account_age_months",
            "num_delinquencies_2yrs",
            "num_public_records",
            "num_collections",
            "num_inquiries_6mo",
            "recent_inquiry_count",
            "oldest_credit_line_age",
            "'open' as account_status",
        ),
        # Applicants without order lines have no row here.
        "financial_ratios": a.where("monthly_income is not null").selectExpr(
            "customer_ref as cust_num",
            *[money_text(c) for c in schemas.MONEY_COLUMNS],
            "debt_to_income_ratio",
            "debt_service_ratio",
            "payment_to_income_ratio",
            "credit_utilization",
        ),
        "loan_details": a.selectExpr(
            "customer_ref as customer_id",
            money_text("loan_amount"),
            f"{pick(LOAN_TEXTS, 'customer_ref')} as loan_type",
            "loan_term",
            "interest_rate",
            "'any' as loan_purpose",
            "collateral_value",
        ),
        "geographic_data": a.selectExpr(
            "cast(customer_ref as string) as id",
            "state",
            "cast(10000 + customer_ref % 90000 as string) as previous_zip_code",
            *[f"cast({c} as string) as {c}" for c in schemas.GEO_NUMBERS],
        ),
    }
