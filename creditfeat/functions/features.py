"""Derived features as data: name -> (inputs, expression).

A feature whose inputs are missing from the table is skipped and reported, never an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE_YEAR = 2025


@dataclass(frozen=True)
class Feature:
    name: str
    inputs: tuple[str, ...]
    build: Callable[..., Column]


def _over(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def _feature(name: str, inputs: str, build: Callable[..., Column]) -> Feature:
    return Feature(name, tuple(inputs.split()), build)


def ratio_features(year: int = REFERENCE_YEAR) -> list[Feature]:
    f = _feature
    return [
        # income
        f("monthly_income_from_annual", "annual_income", lambda a: a / 12),
        f("disposable_income", "monthly_income existing_monthly_debt", lambda m, d: m - d),
        f(
            "income_to_payment_capacity",
            "monthly_income monthly_payment",
            lambda m, p: _over(m, p + 1),
        ),
        f(
            "income_source_match",
            "monthly_income annual_income",
            lambda m, a: _over(F.abs(m - a / 12), a / 12),
        ),
        # debt
        f(
            "total_debt_to_income_annual",
            "total_debt_amount annual_income",
            lambda d, a: _over(d, a + 1),
        ),
        f(
            "debt_payment_burden",
            "existing_monthly_debt monthly_payment monthly_income",
            lambda d, p, m: _over(d + p, m + 1),
        ),
        f(
            "free_cash_flow_ratio",
            "monthly_free_cash_flow monthly_income",
            lambda c, m: _over(c, m + 1),
        ),
        f("loan_to_monthly_income", "loan_amount monthly_income", lambda x, m: _over(x, m + 1)),
        # credit behaviour
        f(
            "credit_age_to_score_ratio",
            "oldest_account_age_months credit_score",
            lambda a, s: _over(a, s + 1),
        ),
        f(
            "delinquency_rate",
            "num_delinquencies_2yrs num_credit_accounts",
            lambda d, n: _over(d, n + 1),
        ),
        f("inquiry_intensity", "num_inquiries_6mo recent_inquiry_count", lambda a, b: a + b),
        f(
            "negative_marks_total",
            "num_delinquencies_2yrs num_public_records num_collections",
            lambda d, r, c: F.coalesce(d, F.lit(0)) + r + c,
        ),
        f(
            "credit_stress_score",
            "credit_utilization debt_to_income_ratio num_delinquencies_2yrs num_credit_accounts",
            lambda u, r, d, n: u * 0.3 + r * 0.3 + _over(d, n + 1) * 0.4,
        ),
        # loan
        f(
            "loan_amount_to_limit",
            "loan_amount total_credit_limit",
            lambda x, limit: _over(x, limit + 1),
        ),
        f("interest_burden", "loan_amount interest_rate", lambda x, r: x * r / 100),
        f("loan_term_years", "loan_term", lambda t: t / 12),
        f("monthly_loan_payment_estimate", "loan_amount loan_term", lambda x, t: _over(x, t + 1)),
        # region
        f(
            "income_to_regional_median",
            "annual_income regional_median_income",
            lambda a, m: _over(a, m + 1),
        ),
        f(
            "housing_affordability",
            "regional_median_rent monthly_income",
            lambda r, m: _over(r, m + 1),
        ),
        f(
            "regional_stress_index",
            "regional_unemployment_rate cost_of_living_index housing_price_index",
            lambda u, c, h: u * 0.4 + c / 100 * 0.3 + h / 100 * 0.3,
        ),
        # behaviour
        f(
            "service_call_intensity",
            "num_customer_service_calls num_login_sessions",
            lambda c, s: _over(c, s + 1),
        ),
        # timing
        f("is_business_hours", "application_hour", lambda h: _flag(h.between(9, 17))),
        f("is_weekend", "application_day_of_week", lambda d: _flag(d.isin(6, 7))),
        f("is_late_night", "application_hour", lambda h: _flag((h >= 22) | (h <= 5))),
        # maturity
        f("account_age_years", "account_open_year", lambda y: F.lit(year) - y),
        f(
            "credit_history_depth",
            "oldest_credit_line_age oldest_account_age_months",
            lambda line, account: line * 0.5 + account * 0.5,
        ),
    ]


def engagement_feature(most_sessions: float | None) -> Feature:
    """Needs the largest session count of the training data, fitted once and reused."""
    return _feature(
        "digital_engagement_score",
        "has_mobile_app paperless_billing num_login_sessions",
        lambda app, paperless, sessions: app * 0.5
        + paperless * 0.3
        + _over(sessions, F.lit(most_sessions).cast("double")) * 0.2,
    )


INTERACTIONS = [
    _feature(
        "debt_credit_interaction",
        "debt_to_income_ratio credit_utilization",
        lambda a, b: a * b,
    ),
    _feature(
        "income_debt_interaction",
        "income_stability_score debt_payment_burden",
        lambda a, b: a * b,
    ),
    _feature("age_credit_interaction", "age credit_score", lambda a, b: a * b / 100),
    _feature(
        "employment_income_stability", "employment_length monthly_income", lambda a, b: a * b
    ),
]


def polynomial_features(columns: Sequence[str]) -> list[Feature]:
    made = []
    for c in columns:
        made.append(Feature(f"{c}_squared", (c,), lambda x: x * x))
        made.append(Feature(f"{c}_cbrt", (c,), F.cbrt))
    return made


# Ratios that the documentation of the domain names.
EXTRA_RATIOS = [
    _feature("loan_to_value_ratio", "loan_amount collateral_value", _over),
    _feature("calculated_dti", "total_monthly_debt_payment monthly_income", _over),
    _feature("calculated_pti", "monthly_payment monthly_income", _over),
    _feature("calculated_utilization", "revolving_balance available_credit", _over),
    _feature(
        "debt_service_coverage",
        "monthly_income existing_monthly_debt monthly_payment",
        lambda m, d, p: _over(m, d + p),
    ),
]


def add_features(df: DataFrame, features: Sequence[Feature]) -> tuple[DataFrame, list[str]]:
    """One projection with all features whose inputs exist; also the names skipped."""
    have = set(df.columns)
    new, skipped = {}, []
    for f in features:
        if have.issuperset(f.inputs):
            new[f.name] = f.build(*[F.col(c).cast("double") for c in f.inputs])
        else:
            skipped.append(f.name)
    return df.withColumns(new), skipped


def annuity_payment(amount: Column, yearly_percent: Column, months: Column) -> Column:
    """Level payment of a loan; interest-free loans are spread evenly."""
    r = yearly_percent / 1200
    growth = F.pow(r + 1, months)
    return F.when(r == 0, F.try_divide(amount, months)).otherwise(
        F.try_divide(amount * (r * growth), growth - 1)
    )


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def zero_placeholders(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Explicit fallback only: out-of-fold columns as 0.0."""
    return df.withColumns({n: F.lit(0.0) for n in names})


def align(
    df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str], list[str]]:
    """Exactly the stored feature list, in its order: missing ones become 0.0, others go.

    Also returns what was added and what was dropped."""
    have = set(df.columns)
    added = [n for n in names if n not in have]
    dropped = [c for c in df.columns if c not in names and c not in keep]
    cols = [
        F.col(n).cast("double").alias(n) if n in have else F.lit(0.0).alias(n) for n in names
    ]
    return df.select(*keep, *cols), added, dropped


def decide(score: Column, threshold: float) -> Column:
    return (score >= F.lit(float(threshold))).cast("int")


def risk_tier(score: Column, review: float = 0.08, reject: float = 0.15) -> Column:
    return (
        F.when(score > reject, "reject").when(score > review, "review").otherwise("approve")
    )
