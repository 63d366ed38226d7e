"""Percentile ranks, mergeable profiles, observed checks and in-join validation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditfeat.operators import joins, ordering, profile, quality


def test_split_and_folds_of_the_anchor(spark):
    """As with the wide rows: the split by key and label, the folds of the training rows after nulls are filled."""
    from creditfeat.catalog.leakfree import _parted
    from creditfeat.operators.folds import with_folds, with_split

    rows = [(i, None if i % 11 == 0 else i % 2, f"A{i}") for i in range(1, 300)]
    df = spark.createDataFrame(rows, "customer_ref long, default int, application_id string")
    parted = with_split(df, "customer_ref", "default")
    train = with_folds(parted.where("split = 'train'").na.fill(0), "customer_ref", "default")
    want = {r.customer_ref: r.fold for r in train.collect()}
    got = _parted(df)
    assert got.columns == [*df.columns, "split", "fold"]
    found = got.collect()
    assert len(found) == 299 and {r.customer_ref: r.default for r in found} == {k: y for k, y, _ in rows}
    assert {r.customer_ref: r.fold for r in found if r.split == "train"} == want
    assert all(r.fold is None for r in found if r.split == "test")


def test_percentile_rank_of_seen_and_unseen_values(spark, monkeypatch):
    rng = np.random.default_rng(1)
    train = rng.integers(0, 40, 300).astype(float)
    asked = [None, -1.0, 0.0, 7.0, 7.5, 39.0, 50.0, *rng.integers(0, 40, 100).astype(float)]
    fitted = profile.empirical_distribution(spark.createDataFrame([(float(v),) for v in train] + [(None,)], "v double"), "v")
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(asked)], "i int, v double")
    for rows in (ordering.ROWS_PER_TASK, 5):
        monkeypatch.setattr(ordering.running_totals, "__defaults__", ((), False, rows))
        got = {r.i: r.rank for r in profile.percentile_rank(df, fitted, "v", "rank").collect()}
        assert len(got) == len(asked)
        for i, v in enumerate(asked):
            if v is None:
                assert got[i] is None
                continue
            less, same = (train < v).sum(), (train == v).sum()
            assert got[i] == pytest.approx((less + (same + 1) / 2 if same else less) / len(train))


def test_merged_profiles_keep_their_error_bounds(spark):
    """Twenty kept batches: quantiles within 1 % of rank, distinct counts within three standard errors."""
    df = spark.range(60_000).select(
        (F.col("id") % 20).alias("batch"),
        (F.hash("id") % 10_000).cast("double").alias("a"),
        F.when(F.col("id") % 3 > 0, F.sqrt(F.col("id").cast("double"))).alias("b"),
    )
    states = profile.profile_state(df, ["a", "b"], ["batch"])
    assert states.count() == 40
    found = {r["column"]: r for r in profile.state_profile(profile.merged_state(states)).collect()}
    rows = df.select("a", "b").toPandas()
    for c in ("a", "b"):
        values = np.sort(rows[c].dropna().to_numpy())
        assert found[c].rows == 60_000 and found[c].nulls == rows[c].isna().sum()
        assert abs(found[c].n_distinct / len(np.unique(values)) - 1) < 0.025
        for i, e in enumerate(found[c].edges):
            low, high = (np.searchsorted(values, e, s) / len(values) for s in ("left", "right"))
            assert low - 0.01 <= i / 10 <= high + 0.01


def test_drift_from_states(spark):
    rng = np.random.default_rng(2)
    rows = [(0, float(v), float(v)) for v in rng.normal(size=20_000)] + [(1, float(v), float(v) + 0.5) for v in rng.normal(size=20_000)]
    df = spark.createDataFrame(rows, "half int, same double, moved double")
    base, other = (df.where(F.col("half") == h) for h in (0, 1))
    exact = {r["column"]: r.psi for r in profile.population_shift(base, other, ["same", "moved"]).collect()}
    states = [profile.merged_state(profile.profile_state(d, ["same", "moved"])) for d in (base, other)]
    got = {r["column"]: r.psi for r in profile.state_shift(*states).collect()}
    assert got.keys() == exact.keys()
    for c in got:
        assert abs(got[c] - exact[c]) < 0.02
    assert got["moved"] > 0.15 > 0.03 > got["same"]


def test_checks_while_writing(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (2, 1, 0.9), (3, 1, 0.4)], "k int, y int, p double")
    written, seen = quality.staged_with_checks(df, "t", ["k", "y"], "y", ["p"])
    assert written.count() == 3 and (seen["rows"], seen["positives"], seen["max_p"]) == (3, 2, 0.9)
    for bad in ((None, 1, 0.1), (4, 7, 0.1), (4, None, 0.1), (4, 1, 1.5)):
        with pytest.raises(AssertionError):
            quality.staged_with_checks(df.union(spark.createDataFrame([bad], df.schema)), "t", ["k"], "y", ["p"])
    _, none = quality.staged_with_checks(df.limit(0), "t", ["k"], "y", ["p"])
    assert none["rows"] == 0


def test_validation_inside_the_join(spark):
    anchor = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (None, 0)], "k long, y int")
    good = spark.createDataFrame([("1", 5), (None, 6), (None, 7)], "id string, v int")
    out = joins.star_join(anchor, {"s": (good, "id")}, "k", "in join")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 0, 5), (2, 1, None), (None, 1, None), (None, 0, None)], key=str)
    for left, right in ((anchor, [("7", 1), ("07", 2)]), (anchor.union(anchor), [("1", 5)])):
        joined = joins.star_join(left, {"s": (spark.createDataFrame(right, "id string, v int"), "id")}, "k", "in join")
        for action in (lambda d: d.collect(), lambda d: d.count(), lambda d: d.select("y").collect()):
            with pytest.raises(Exception, match="not unique"):
                action(joined)


def test_one_shuffle_a_source(spark):
    """The count of a key and the join on it use one exchange."""
    tables = [spark.range(100).selectExpr(f"id as k{i}", f"id as v{i}") for i in range(3)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = joins.star_join(tables[0], {f"t{i}": (tables[i], f"k{i}") for i in (1, 2)}, "k0", "in join")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 3
