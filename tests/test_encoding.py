"""Supervised encoders against brute force, and the leak test."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditfeat.operators.encoders import LabelEncoder, TargetEncoder, fold_moments
from creditfeat.operators.woe import WoeEncoder

SCHEMA = "id long, y int, fold int, c string, x double"


def rows(n=300, seed=0):
    rng = np.random.default_rng(seed)
    return [
        (i, int(rng.random() < 0.3), i % 5, "abcde"[int(rng.integers(5))], float(rng.integers(40)))
        for i in range(n)
    ]


def smoothed(train, category, m=10):
    prior = np.mean([r[1] for r in train])
    own = [r[1] for r in train if r[3] == category]
    return (sum(own) + prior * m) / (len(own) + m)


def test_target_encoding_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    enc = TargetEncoder.fit(df, ["c"], "y", "fold")
    for r in enc.transform(df, "oof").collect():
        train = [t for t in data if t[2] != r["fold"]]
        assert r["c_target_oof"] == pytest.approx(smoothed(train, r["c"]))
    new = spark.createDataFrame([(1, "a"), (2, "never seen"), (3, None)], "id long, c string")
    full = {r["id"]: r["c_target_oof"] for r in enc.transform(new, "full_fit").collect()}
    prior = np.mean([r[1] for r in data])
    assert full[1] == pytest.approx(smoothed(data, "a"))
    assert full[2] == full[3] == pytest.approx(prior)
    mean = {r["id"]: r["c_target_oof"] for r in enc.transform(new, "fold_mean").collect()}
    parts = [smoothed([t for t in data if t[2] != f], "a") for f in range(5)]
    assert mean[1] == pytest.approx(np.mean(parts))


def test_large_tables_are_joined_instead_of_broadcast(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    small = TargetEncoder.fit(df, ["c"], "y", "fold")
    monkeypatch.setattr("creditfeat.staging.settle.__defaults__", (2,))
    large = TargetEncoder.fit(df, ["c"], "y", "fold")
    assert small.small and not large.small
    pick = lambda e: sorted(map(tuple, e.transform(df, "oof").select("id", "c_target_oof").collect()))
    assert pick(small) == pick(large)


def test_one_large_column_moves_no_rows_for_small_ones(spark, monkeypatch):
    """The column with many categories is joined; a column with few stays a broadcast."""
    df = spark.createDataFrame([(i, "abc"[i % 3], f"z{i % 50:02}", None) for i in range(100)], "id int, c string, zip string, no string")
    want = sorted((i, i % 3, i % 50, 0) for i in range(100))
    for limit, few in ((10, {"c"}), (1000, {"c", "zip"}), (1, set())):
        monkeypatch.setattr("creditfeat.staging.settle_columns.__defaults__", (limit,))
        enc = LabelEncoder.fit(df, ["c", "zip", "no"])
        assert enc.few == few and enc.sizes == {"c": 3, "zip": 50, "no": 0}
        assert sorted(map(tuple, enc.transform(df).collect())) == want
        assert enc.table.count() == 53
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr("creditfeat.staging.settle_columns.__defaults__", (10,))
        plan = LabelEncoder.fit(df, ["c", "zip"]).transform(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def woe_brute(train, value):
    x = np.array([t[4] for t in train])
    y = np.array([t[1] for t in train])
    edges = np.unique(np.quantile(x, np.linspace(0, 1, 11)))
    if len(edges) < 2 or value < edges[0] or value > edges[-1]:
        return 0.0
    place = lambda v: max(int((edges < v).sum()), 1)
    same = np.array([place(v) for v in x]) == place(value)
    good, bad = max((y[same] == 0).sum(), 0.5), max((y[same] == 1).sum(), 0.5)
    return math.log((good / (y == 0).sum()) / (bad / (y == 1).sum()))


def test_woe_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    enc = WoeEncoder.fit(df, ["x"], "y", "fold")
    for r in enc.transform(df, "oof").collect():
        train = [t for t in data if t[2] != r["fold"]]
        assert r["x_woe_oof"] == pytest.approx(woe_brute(train, r["x"]))
    lowest = min(t[4] for t in data)
    new = spark.createDataFrame([(lowest,), (lowest - 1,), (1e9,), (None,)], "x double")
    got = [r["x_woe_oof"] for r in enc.transform(new, "full_fit").collect()]
    assert got == pytest.approx([woe_brute(data, lowest), 0.0, 0.0, 0.0])
    again = WoeEncoder.from_rows(["x"], 5, False, enc.table(spark).collect())
    assert again.edges == enc.edges and again.values == enc.values


def test_woe_changes_sign_with_the_label(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    flipped = df.withColumn("y", 1 - F.col("y"))
    a = WoeEncoder.fit(df, ["x"], "y").values
    b = WoeEncoder.fit(flipped, ["x"], "y").values
    for k in a:
        assert a[k] == pytest.approx([-v for v in b[k]])


def test_constant_column(spark):
    df = spark.createDataFrame([(i, i % 2, i % 5, "a", 7.0) for i in range(50)], SCHEMA)
    out = WoeEncoder.fit(df, ["x"], "y", "fold").transform(df, "oof")
    assert {r["x_woe_oof"] for r in out.collect()} == {0.0}
    assert fold_moments(df, ["x"], "fold", 5)[0] == ([7.0], [1.0])


def test_labels_of_a_fold_never_reach_its_features(spark):
    """The leak test: flipping labels inside fold 2 changes nothing in fold 2."""
    df = spark.createDataFrame(rows(), SCHEMA)
    other = df.withColumn("y", F.when(F.col("fold") == 2, 1 - F.col("y")).otherwise(F.col("y")))

    def features(source):
        te = TargetEncoder.fit(source, ["c"], "y", "fold").transform(source, "oof")
        out = WoeEncoder.fit(source, ["x"], "y", "fold").transform(te, "oof").where("fold = 2")
        return sorted(map(tuple, out.select("id", "c_target_oof", "x_woe_oof").collect()))

    assert features(df) == features(other)


def test_label_codes_in_text_order_with_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "c string")
    enc = LabelEncoder.fit(df, ["c"])
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("zzz",)], "c string")
    assert [r["c"] for r in enc.transform(new).collect()] == [0, 1, 2, 3]


def test_target_encoding_without_rows_or_outside_rows(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 0), ("b", 1, 0)], "c string, y int, fold int")
    none = TargetEncoder.fit(df.limit(0), ["c"], "y", "fold")
    assert none.prior == 0.0 and none.fold_priors == [0.0] * 5
    assert [r.c_target_oof for r in none.transform(df, "oof").collect()] == [0.0] * 3
    one = TargetEncoder.fit(df, ["c"], "y", "fold")  # nothing lies outside fold 0
    assert one.fold_priors[0] == one.prior == 2 / 3
    assert {round(r.c_target_oof, 9) for r in one.transform(df, "oof").collect()} == {round(2 / 3, 9)}
