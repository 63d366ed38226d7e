"""Cleaning expressions: money text, category rules, casts and null fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The first rule with a word that occurs in the upper-case text wins.
EMPLOYMENT_RULES = [
    ("Full-time", ["FULL", "FT"]),
    ("Part-time", ["PART", "PT"]),
    ("Self-employed", ["SELF", "CONTRACT"]),
]
LOAN_RULES = [
    ("Personal", ["PERSONAL"]),
    ("Mortgage", ["MORTGAGE", "HOME"]),
    ("Credit Card", ["CREDIT", "CC"]),
    ("Auto", ["AUTO", "CAR"]),
]


def money(column: str) -> Column:
    """'$4,250' to 4250.0; the text 'nan' is null; other junk raises."""
    bare = F.replace(F.replace(F.col(column), F.lit("$")), F.lit(","))
    return F.when(F.lower(bare) != "nan", bare).cast("double")


def clean_money(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clean those of ``columns`` that the table has and that hold text."""
    texts = [c for c in columns if c in df.columns and df.schema[c].dataType == T.StringType()]
    return df.withColumns({c: money(c) for c in texts})


def by_rules(column: str, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Map text to the class of the first matching rule; null and no match give ``default``."""
    upper = F.upper(F.col(column))
    result = F
    for name, words in rules:
        match = F.lit(False)
        for word in words:
            match = match | upper.contains(word)
        result = result.when(match, F.lit(name))
    return result.otherwise(F.lit(default))


def employment_class(column: str = "employment_type") -> Column:
    return by_rules(column, EMPLOYMENT_RULES, "Other")


def loan_class(column: str = "loan_type") -> Column:
    return by_rules(column, LOAN_RULES, "Other")


def dashed_upper(column: str) -> Column:
    return F.replace(F.upper(F.col(column)), F.lit(" "), F.lit("-"))


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what is no number becomes null."""
    return df.withColumns(
        {c: F.col(c).try_cast("double") for c in columns if c in df.columns}
    )


def cast_strict(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Casts that raise on bad input (ANSI mode is the default)."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def nan_to_null(df: DataFrame) -> DataFrame:
    """At ingest, floating NaN means missing."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def fill_table(df: DataFrame) -> DataFrame:
    """0 in every numeric and '0' in every text column that is null."""
    return df.na.fill(0).na.fill("0")


def drop_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)
