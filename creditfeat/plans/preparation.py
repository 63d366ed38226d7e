"""From the six raw tables to the wide, cleaned applicant table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditfeat import schemas
from creditfeat.functions import cleaning, features
from creditfeat.operators.joins import star_join


def clean_sources(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Each source by its own rules; pure projections."""
    t = dict(raw)
    t["application_metadata"] = cleaning.drop_present(
        t["application_metadata"], schemas.NOISE_COLUMNS
    )
    t["demographics"] = (
        cleaning.clean_money(t["demographics"], ["annual_income"])
        .withColumn("employment_type", cleaning.employment_class())
        .na.fill({"employment_length": 0})
    )
    t["credit_history"] = t["credit_history"].na.fill({"num_delinquencies_2yrs": 0})
    t["financial_ratios"] = cleaning.clean_money(
        t["financial_ratios"], schemas.MONEY_COLUMNS
    ).na.fill({"revolving_balance": 0})
    t["loan_details"] = cleaning.clean_money(t["loan_details"], ["loan_amount"]).withColumn(
        "loan_type", cleaning.loan_class()
    )
    t["geographic_data"] = cleaning.to_numbers(t["geographic_data"], schemas.GEO_NUMBERS)
    return {name: cleaning.nan_to_null(df) for name, df in t.items()}


def merge_sources(clean: Mapping[str, DataFrame], check: bool | str = "in join") -> DataFrame:
    satellites = {name: (clean[name], key) for name, key in schemas.SATELLITE_KEYS.items()}
    return star_join(clean["application_metadata"], satellites, schemas.KEY, check)


def most_sessions(train: DataFrame) -> float | None:
    """The scale of the engagement score, fitted on training rows."""
    return train.agg(F.max("num_login_sessions").cast("double")).first()[0]


def derive(df: DataFrame, sessions: float | None) -> tuple[DataFrame, list[str]]:
    """Ratios, engagement score, null fill, then interactions and polynomials of the
    filled values. Also the names of features whose inputs are missing."""
    df, skipped = features.add_features(
        df, [*features.ratio_features(), features.engagement_feature(sessions)]
    )
    df = cleaning.fill_table(df)
    df, more = features.add_features(
        df,
        [*features.INTERACTIONS, *features.polynomial_features(schemas.POLYNOMIAL_COLUMNS)],
    )
    return df, skipped + more
