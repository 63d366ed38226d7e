"""Cleaning, derivation and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat import schemas
from creditfeat.catalog import Catalog
from creditfeat.catalog.fixtures import (
    APPLICANT,
    EMPLOYMENT_TEXTS,
    LOAN_TEXTS,
    applicants,
    applicants_sql,
    pick,
    raw_sources,
    split_sql,
    table,
)
from creditfeat.functions import cleaning, features
from creditfeat.operators import joins
from creditfeat.operators.encoders import TargetEncoder
from creditfeat.operators.folds import with_split
from creditfeat.operators.woe import bin_number
from creditfeat.plans.preparation import clean_sources, merge_sources
from creditfeat.sources.applicants import through_files
from creditfeat.staging import lookup, settle

CATALOG = Catalog()


@CATALOG.query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_present(
        table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderstatus", "random_noise_1"]
    )


@CATALOG.query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS amount
    FROM orders"""
)
def clean_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        """case o_orderstatus when 'P' then 'nan' when 'O' then cast(o_totalprice as string)
           else concat('$', format_number(o_totalprice, 2)) end as amount""",
    )
    return cleaning.clean_money(text, ["amount"])


@CATALOG.query("SELECT l_orderkey, l_extendedprice, l_quantity FROM lineitem")
def clean_money_if_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column is cleaned, a numeric one is left alone."""
    mixed = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "format_number(l_extendedprice, 2) as l_extendedprice", "l_quantity"
    )
    return cleaning.clean_money(mixed, ["l_extendedprice", "l_quantity", "absent"])


def _class_case(texts: list[str], classes: list[str], number: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(classes))
    return f"CASE {number} % {len(texts)} {cases} END"


@CATALOG.query(
    f"""SELECT c_custkey, {_class_case(
        EMPLOYMENT_TEXTS,
        ["Full-time", "Full-time", "Full-time", "Part-time", "Part-time", "Self-employed",
         "Self-employed", "Other"], "c_custkey")} AS employment_type FROM customer"""
)
def normalize_employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", f"{pick(EMPLOYMENT_TEXTS, 'c_custkey')} as employment_type"
    )
    return df.withColumn("employment_type", cleaning.employment_class())


@CATALOG.query(
    f"""SELECT o_orderkey, {_class_case(
        LOAN_TEXTS,
        ["Personal", "Mortgage", "Mortgage", "Credit Card", "Credit Card", "Auto", "Auto",
         "Other"], "o_orderkey")} AS loan_type FROM orders"""
)
def normalize_loan_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{pick(LOAN_TEXTS, 'o_orderkey')} as loan_type"
    )
    return df.withColumn("loan_type", cleaning.loan_class())


@CATALOG.query(
    "SELECT o_orderkey, replace(upper(o_orderpriority), ' ', '-') AS o_orderpriority FROM orders"
)
def normalize_dashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", cleaning.dashed_upper("o_orderpriority").alias("o_orderpriority")
    )


@CATALOG.query(
    """SELECT event_id, cast(user_id AS VARCHAR) AS user_id, value,
      cast(json_extract_string(props, '$.k') AS INT) AS k FROM events"""
)
def cast_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("value").cast("string").alias("value"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    return cleaning.cast_strict(df, {"user_id": "string", "value": "double", "k": "int"})


@CATALOG.query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value
    FROM events"""
)
def cast_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "case event_type when 'error' then 'bad' else concat(' ', value, ' ') end as value",
    )
    return cleaning.to_numbers(df, ["value"])


_FILLED = ["employment_length", "num_delinquencies_2yrs", "revolving_balance"]


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", *_FILLED])}
    SELECT customer_ref, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _FILLED)}
    FROM applicants"""
)
def fill_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applicants(spark, sf_dir, ["customer_ref", *_FILLED]).na.fill(dict.fromkeys(_FILLED, 0))


_TEXTS = schemas.TARGET_ENCODED
_NUMBERS = ["monthly_income", "credit_utilization", "employment_length", "num_login_sessions"]


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", *_TEXTS, *_NUMBERS])}
    SELECT customer_ref,
      {", ".join(f"CASE WHEN customer_ref % 9 = 0 THEN '0' ELSE {c} END AS {c}" for c in _TEXTS)},
      {", ".join(f"coalesce({c}, 0) AS {c}" for c in _NUMBERS)} FROM applicants"""
)
def fill_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", *_TEXTS, *_NUMBERS])
    gaps = df.withColumns({c: F.when(F.col("customer_ref") % 9 != 0, F.col(c)) for c in _TEXTS})
    return cleaning.fill_table(gaps)


# -- derivation --------------------------------------------------------------------------

_RATIO_SQL = {
    "monthly_income_from_annual": "annual_income / 12",
    "disposable_income": "monthly_income - existing_monthly_debt",
    "income_to_payment_capacity": "monthly_income / nullif(monthly_payment + 1, 0)",
    "income_source_match": "abs(monthly_income - annual_income / 12) / nullif(annual_income / 12, 0)",
    "total_debt_to_income_annual": "total_debt_amount / nullif(annual_income + 1, 0)",
    "debt_payment_burden": "(existing_monthly_debt + monthly_payment) / nullif(monthly_income + 1, 0)",
    "free_cash_flow_ratio": "monthly_free_cash_flow / nullif(monthly_income + 1, 0)",
    "loan_to_monthly_income": "loan_amount / nullif(monthly_income + 1, 0)",
    "credit_age_to_score_ratio": "oldest_account_age_months / (credit_score + 1)",
    "delinquency_rate": "num_delinquencies_2yrs / (num_credit_accounts + 1)",
    "inquiry_intensity": "num_inquiries_6mo + recent_inquiry_count",
    "negative_marks_total": "coalesce(num_delinquencies_2yrs, 0) + num_public_records + num_collections",
    "credit_stress_score": "credit_utilization * 0.3 + debt_to_income_ratio * 0.3"
    " + num_delinquencies_2yrs / (num_credit_accounts + 1) * 0.4",
    "loan_amount_to_limit": "loan_amount / nullif(total_credit_limit + 1, 0)",
    "interest_burden": "loan_amount * interest_rate / 100",
    "loan_term_years": "loan_term / 12",
    "monthly_loan_payment_estimate": "loan_amount / (loan_term + 1)",
    "income_to_regional_median": "annual_income / (regional_median_income + 1)",
    "housing_affordability": "regional_median_rent / nullif(monthly_income + 1, 0)",
    "regional_stress_index": "regional_unemployment_rate * 0.4 + cost_of_living_index / 100 * 0.3"
    " + housing_price_index / 100 * 0.3",
    "service_call_intensity": "num_customer_service_calls / (num_login_sessions + 1)",
    "is_business_hours": "(application_hour BETWEEN 9 AND 17)::INT",
    "is_weekend": "(application_day_of_week IN (6, 7))::INT",
    "is_late_night": "(application_hour >= 22 OR application_hour <= 5)::INT",
    "account_age_years": "(2025 - account_open_year)::DOUBLE",
    "credit_history_depth": "oldest_credit_line_age * 0.5 + oldest_account_age_months * 0.5",
}


@CATALOG.query(
    f"""WITH {applicants_sql()}
    SELECT customer_ref, {", ".join(f"{e} AS {n}" for n, e in _RATIO_SQL.items())}
    FROM applicants"""
)
def ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = features.add_features(applicants(spark, sf_dir), features.ratio_features())
    return df.select("customer_ref", *_RATIO_SQL)


@CATALOG.query(
    """SELECT event_id, (hour(ts) BETWEEN 9 AND 17)::INT AS is_business_hours,
      (isodow(ts) IN (6, 7))::INT AS is_weekend,
      (hour(ts) >= 22 OR hour(ts) <= 5)::INT AS is_late_night FROM events"""
)
def timing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour and weekday come from a timestamp here."""
    df = table(spark, sf_dir, "events").select(
        "event_id",
        F.hour("ts").alias("application_hour"),
        (F.weekday("ts") + 1).alias("application_day_of_week"),
    )
    flags, _ = features.add_features(df, features.ratio_features())
    return flags.select("event_id", "is_business_hours", "is_weekend", "is_late_night")


_INTERACT = ["debt_to_income_ratio", "credit_utilization", "age", "credit_score"]
_INTERACT += ["employment_length", "monthly_income"]


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", *_INTERACT])}
    SELECT customer_ref, debt_to_income_ratio * credit_utilization AS debt_credit_interaction,
      age * credit_score / 100 AS age_credit_interaction,
      employment_length * monthly_income AS employment_income_stability,
      'income_debt_interaction' AS skipped FROM applicants"""
)
def optional_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the four lacks an input: it is skipped and reported."""
    df = applicants(spark, sf_dir, ["customer_ref", *_INTERACT])
    made, skipped = features.add_features(df, features.INTERACTIONS)
    return made.drop(*_INTERACT).withColumn("skipped", F.lit(",".join(skipped)))


_POLY = ["debt_to_income_ratio", "credit_utilization", "annual_income"]


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", *_POLY])}
    SELECT customer_ref, {", ".join(
        f"{c} * {c} AS {c}_squared, round(cbrt({c}), 9) AS {c}_cbrt" for c in _POLY)}
    FROM applicants"""
)
def polynomial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", *_POLY])
    made, _ = features.add_features(df, features.polynomial_features(_POLY))
    return made.drop(*_POLY).withColumns({f"{c}_cbrt": F.round(f"{c}_cbrt", 9) for c in _POLY})


_ENGAGED = ["num_login_sessions", "has_mobile_app", "paperless_billing"]


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "default", *_ENGAGED])}, {split_sql()},
    top AS (SELECT max(num_login_sessions)::DOUBLE AS m FROM parted WHERE split = 'train')
    SELECT customer_ref, has_mobile_app * 0.5::DOUBLE + paperless_billing * 0.3::DOUBLE
      + num_login_sessions / m * 0.2::DOUBLE AS digital_engagement_score FROM parted, top"""
)
def engagement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest session count is learnt on the training part and applied to all rows."""
    df = applicants(spark, sf_dir, ["customer_ref", "default", *_ENGAGED])
    train = with_split(df, "customer_ref", "default").where("split = 'train'")
    top = train.agg(F.max("num_login_sessions")).first()[0]
    made, _ = features.add_features(df, [features.engagement_feature(top)])
    return made.select("customer_ref", "digital_engagement_score")


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "age", "loan_amount"])}
    SELECT customer_ref, loan_amount, 0.0::DOUBLE AS knn_oof_50, age::DOUBLE AS age,
      'knn_oof_50' AS added, 'state' AS dropped FROM applicants"""
)
def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", "state", "age", "loan_amount"])
    out, added, dropped = features.align(
        df, ["loan_amount", "knn_oof_50", "age"], keep=["customer_ref"]
    )
    return out.withColumns({"added": F.lit(",".join(added)), "dropped": F.lit(",".join(dropped))})


@CATALOG.query("SELECT o_orderkey, 0.0::DOUBLE AS knn_oof_50, 0.0::DOUBLE AS knn_oof_100 FROM orders")
def zero_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    return features.zero_placeholders(df, ["knn_oof_50", "knn_oof_100"])


_STATE_SQL = f"""{applicants_sql(["customer_ref", "default", "state"])},
    prior AS (SELECT sum("default")::DOUBLE / count(*)::DOUBLE AS g FROM applicants),
    enc AS (SELECT state AS s, (sum("default")::DOUBLE + g * 10.0::DOUBLE)
        / (count(*)::DOUBLE + 10.0::DOUBLE) AS prob FROM applicants, prior GROUP BY state, g),
    scored AS (SELECT customer_ref, prob FROM applicants JOIN enc ON s = state)"""


def _state_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", "default", "state"])
    scored = TargetEncoder.fit(df, ["state"], "default").transform(df, "full_fit", suffix="_p")
    return scored.select("customer_ref", F.col("state_p").alias("prob"))


@CATALOG.query(
    f"""WITH {_STATE_SQL}
    SELECT customer_ref AS customer_id, prob, (prob >= 0.33)::INT AS "default" FROM scored"""
)
def decide_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_scores(spark, sf_dir).select(
        F.col("customer_ref").alias("customer_id"),
        "prob",
        features.decide(F.col("prob"), 0.33).alias("default"),
    )


@CATALOG.query(
    f"""WITH {_STATE_SQL}
    SELECT customer_ref, CASE WHEN prob > 0.34 THEN 'reject' WHEN prob > 0.32 THEN 'review'
      ELSE 'approve' END AS tier FROM scored"""
)
def risk_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_scores(spark, sf_dir).select(
        "customer_ref", features.risk_tier(F.col("prob"), review=0.32, reject=0.34).alias("tier")
    )


# -- joins -------------------------------------------------------------------------------

_CLEAN_SQL = {
    **{
        c: f'"{c}"'
        for c in APPLICANT
        if c not in ("employment_type", "total_credit_limit", "num_dependents")
    },
    "employment_type": _class_case(
        EMPLOYMENT_TEXTS,
        ["Full-time", "Full-time", "Full-time", "Part-time", "Part-time", "Self-employed"]
        + ["Self-employed", "Other"],
        "age",
    ),
    "employment_length": "coalesce(employment_length, 0)",
    "num_delinquencies_2yrs": "coalesce(num_delinquencies_2yrs, 0)",
    # Filled in its own source; an applicant without that source stays null.
    "revolving_balance": "CASE WHEN monthly_income IS NOT NULL"
    " THEN coalesce(revolving_balance, 0) END",
}


@CATALOG.query(
    f"""WITH {applicants_sql()}
    SELECT {", ".join(f'{e} AS "{n}"' for n, e in _CLEAN_SQL.items())} FROM applicants"""
)
def star_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six raw tables, cleaned and joined with key validation."""
    merged = merge_sources(clean_sources(raw_sources(spark, sf_dir)))
    return merged.select(*_CLEAN_SQL)


_ALL_SQL = {
    **_CLEAN_SQL,
    "total_credit_limit": "total_credit_limit",
    "num_dependents": "num_dependents",
    "application_id": "'A' || customer_ref",
    "account_status_code": "'OK'",
    "preferred_contact": "CASE WHEN has_mobile_app = 1 THEN 'app' ELSE 'mail' END",
    "referral_code": "'R' || customer_ref % 10",
    "account_status": "'open'",
    "loan_purpose": "'any'",
    "previous_zip_code": "(10000 + customer_ref % 90000)::VARCHAR",
}


@CATALOG.query(
    f"""WITH {applicants_sql()}
    SELECT {", ".join(f'{e} AS "{n}"' for n, e in _ALL_SQL.items())} FROM applicants"""
)
def ingest_six_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six sources written in their own formats, read back with the source schemas, cleaned
    and joined, with all columns of the result."""
    raw = raw_sources(spark, sf_dir)
    return merge_sources(clean_sources(through_files(spark, raw))).select(*_ALL_SQL)


@CATALOG.query("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def validate_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that forbid a 1:1 join."""
    return joins.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


@CATALOG.query(
    """SELECT o_orderkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
)
def missing_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.without_partner(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey"
    )


@CATALOG.query(
    """SELECT o_orderkey, coalesce(a, -1.0) AS balance FROM orders LEFT JOIN (
      SELECT c_custkey, c_acctbal AS a FROM customer WHERE c_mktsegment = 'BUILDING')
      ON c_custkey = o_custkey"""
)
def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted mapping applied to a column, with a default for unknown values."""
    known = (
        table(spark, sf_dir, "customer")
        .where("c_mktsegment = 'BUILDING'")
        .select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    )
    mapping, small = settle(known)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookup(orders, mapping, ["o_custkey"], small).select(
        "o_orderkey", F.coalesce("c_acctbal", F.lit(-1.0)).alias("balance")
    )


_EDGES = [1000.0, 50000.0, 100000.0, 200000.0, 300000.0]


@CATALOG.query(
    f"""SELECT o_orderkey, CASE WHEN o_totalprice = e[1] THEN 1
        WHEN o_totalprice BETWEEN e[1] AND e[5]
        THEN len(list_filter(e, lambda q: q < o_totalprice)) END::INT AS bin
    FROM orders, (SELECT {_EDGES}::DOUBLE[] AS e)"""
)
def bin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = F.array(*[F.lit(e) for e in _EDGES])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", bin_number(F.col("o_totalprice"), edges).alias("bin")
    )


# -- from the documentation only ---------------------------------------------------------


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "employment_length", "revolving_balance"])}
    SELECT *, (employment_length IS NULL)::INT AS employment_length_missing,
      (revolving_balance IS NULL)::INT AS revolving_balance_missing FROM applicants"""
)
def missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["employment_length", "revolving_balance"]
    return features.missing_flags(applicants(spark, sf_dir, ["customer_ref", *columns]), columns)


@CATALOG.query(
    f"""WITH {applicants_sql(["customer_ref", "loan_amount", "interest_rate", "loan_term"])}
    SELECT customer_ref, round(CASE WHEN interest_rate = 0 THEN loan_amount / loan_term
      ELSE loan_amount * (interest_rate / 1200 * pow(interest_rate / 1200 + 1, loan_term))
        / (pow(interest_rate / 1200 + 1, loan_term) - 1) END, 4) AS payment FROM applicants"""
)
def annuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applicants(spark, sf_dir, ["customer_ref", "loan_amount", "interest_rate", "loan_term"])
    amount, rate, term = (F.col(c) for c in ("loan_amount", "interest_rate", "loan_term"))
    return df.select(
        "customer_ref", F.round(features.annuity_payment(amount, rate, term), 4).alias("payment")
    )


@CATALOG.query(
    f"""WITH {applicants_sql()}
    SELECT customer_ref, loan_amount / nullif(collateral_value, 0) AS loan_to_value_ratio,
      total_monthly_debt_payment / nullif(monthly_income, 0) AS calculated_dti,
      monthly_payment / nullif(monthly_income, 0) AS calculated_pti,
      revolving_balance / nullif(available_credit, 0) AS calculated_utilization,
      monthly_income / nullif(existing_monthly_debt + monthly_payment, 0) AS debt_service_coverage
    FROM applicants"""
)
def extra_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = features.add_features(applicants(spark, sf_dir), features.EXTRA_RATIOS)
    return df.select("customer_ref", *[f.name for f in features.EXTRA_RATIOS])
