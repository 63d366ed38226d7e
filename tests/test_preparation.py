"""Cleaning rules, derived features and joins on dirty hand-made rows."""

import pytest
from pyspark.sql import functions as F

from creditfeat.functions import cleaning, features
from creditfeat.operators import joins, quality


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def frame(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"id int, v {kind}")


def test_money(spark):
    df = frame(spark, ["$61,800", "28600", "75,400", "$3,125.50", "nan", None])
    got = column(cleaning.clean_money(df, ["v"]), "v")
    assert got == [61800.0, 28600.0, 75400.0, 3125.5, None, None]


def test_money_rejects_junk(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cleaning.clean_money(frame(spark, ["abc"]), ["v"]).collect()


def test_employment_and_loan_rules(spark):
    texts = ["Full-time", "FULL_TIME", "Full Time", "FT", "PART_TIME", "PT"]
    texts += ["SELF_EMPLOYED", "Contract", "retired", None]
    got = column(frame(spark, texts).withColumn("v", cleaning.employment_class("v")), "v")
    assert got == ["Full-time"] * 4 + ["Part-time"] * 2 + ["Self-employed"] * 2 + ["Other"] * 2
    loans = ["personal loan", "HOME_LOAN", "home mortgage", "CC", "Credit Card", "Car Loan"]
    loans += ["AUTO_LOAN", "boat"]
    got = column(frame(spark, loans).withColumn("v", cleaning.loan_class("v")), "v")
    want = ["Personal", "Mortgage", "Mortgage", "Credit Card", "Credit Card", "Auto", "Auto"]
    assert got == [*want, "Other"]


def test_coercing_cast(spark):
    df = cleaning.to_numbers(frame(spark, ["5.2", " 5.2 ", "bad", None]), ["v"])
    assert column(df, "v") == [5.2, 5.2, None, None]


def test_nan_becomes_null_and_fill(spark):
    df = frame(spark, [1.0, float("nan"), None], "double")
    assert column(cleaning.nan_to_null(df), "v") == [1.0, None, None]
    assert column(cleaning.fill_table(frame(spark, ["a", None])), "v") == ["a", "0"]


def test_division_by_zero_is_null_and_flags_of_null_are_zero(spark):
    schema = "monthly_income double, monthly_payment double, application_hour int"
    df = spark.createDataFrame([(5.0, -1.0, None)], schema)
    made, skipped = features.add_features(df, features.ratio_features())
    row = made.first()
    assert row["income_to_payment_capacity"] is None
    assert row["is_late_night"] == 0
    assert "credit_stress_score" in skipped


def test_align_adds_drops_and_orders(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "id int, b double, c string")
    out, added, dropped = features.align(df, ["z", "b"], keep=["id"])
    assert (out.columns, added, dropped) == (["id", "z", "b"], ["z"], ["c"])


def test_star_join_validates_and_keeps_rows(spark):
    anchor = spark.createDataFrame([(1,), (2,)], "k long")
    good = spark.createDataFrame([("1", 5)], "id string, v int")
    twice = spark.createDataFrame([(1, 5), (1, 6)], "id long, v int")
    out = joins.star_join(anchor, {"s": (good, "id")}, "k")
    assert sorted(map(tuple, out.collect())) == [(1, 5), (2, None)]
    with pytest.raises(ValueError, match="not unique"):
        joins.star_join(anchor, {"s": (twice, "id")}, "k")
    with pytest.raises(ValueError):
        joins.validate(anchor, twice, "k", "id", "1:1")
    joins.validate(anchor, twice, "k", "id", "1:m")
    assert joins.without_partner(anchor, good, "k", "id").collect() == [(2,)]


def test_quality_checks_raise(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "k int, y int")
    report = quality.run_checks(quality.no_nulls(df), quality.key_unique(df, "k"))
    assert {r["check"]: r["passed"] for r in report.collect()} == {
        "no_nulls": False,
        "key_unique": True,
    }
    with pytest.raises(AssertionError, match="no_nulls"):
        quality.raise_on_failure(report)
    assert quality.numeric_type(df, "y").first()["passed"]


def test_annuity(spark):
    df = spark.createDataFrame([(1200.0, 0.0, 12), (1000.0, 12.0, 1)], "a double, r double, n int")
    got = df.select(features.annuity_payment(F.col("a"), F.col("r"), F.col("n")).alias("p"))
    assert [r["p"] for r in got.collect()] == pytest.approx([100.0, 1010.0])


def test_keys_that_are_equal_after_the_cast_are_refused(spark):
    anchor = spark.createDataFrame([(7,)], "k bigint")
    twice = spark.createDataFrame([("7", 1), ("07", 2)], "id string, v int")
    with pytest.raises(ValueError, match="not unique"):
        joins.star_join(anchor, {"s": (twice, "id")}, "k")
    with pytest.raises(ValueError, match="not unique"):
        joins.validate(anchor, twice, "k", "id", "1:1")
