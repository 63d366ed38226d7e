"""Metrics against brute force on scores with many ties."""

import numpy as np
import pytest

from creditfeat.operators import metrics, profile


def data(n=500, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = (rng.random(n) * 0.7 + y * 0.2).round(1)  # few distinct scores
    return [(int(a), float(b), int(i % 3)) for i, (a, b) in enumerate(zip(y, p, strict=True))]


def pair_auc(rows):
    pos = [p for y, p, _ in rows if y]
    neg = [p for y, p, _ in rows if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(data(), "y int, p double, fold int")


def test_auc_overall_and_by_group(df):
    assert metrics.auc(df, "p", "y").first()["auc"] == pytest.approx(pair_auc(data()))
    for r in metrics.auc(df, "p", "y", ["fold"]).collect():
        own = [x for x in data() if x[2] == r["fold"]]
        assert r["auc"] == pytest.approx(pair_auc(own))


def test_thresholds(df):
    rows = data()
    points = metrics.roc_points(df, "p", "y")
    y, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def best(value):
        return max(sorted(set(p)), key=lambda t: (value(p >= t), t))

    j = best(lambda d: round((d & (y == 1)).sum() / y.sum() - (d & (y == 0)).sum() / (1 - y).sum(), 12))
    assert metrics.youden(points).first()["threshold"] == j
    cost = best(lambda d: -(100 * (~d & (y == 1)).sum() + 10 * (d & (y == 0)).sum()))
    assert metrics.cost_threshold(points).first()["threshold"] == cost
    f1 = best(lambda d: round(2 * (d & (y == 1)).sum() / (d.sum() + y.sum()), 12))
    assert metrics.best_f1(points).first()["threshold"] == f1


def test_single_class_has_no_auc(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, p double")
    assert metrics.auc(one, "p", "y").first()["auc"] is None


def test_gains_share_ties(spark):
    tied = spark.createDataFrame([(i % 2, 0.5) for i in range(100)], "y int, p double")
    got = metrics.gains_table(tied, "p", "y", [0.1, 0.5]).orderBy("rejection_rate").collect()
    assert [r["capture_rate"] for r in got] == pytest.approx([0.1, 0.5])


def test_weight_grid_finds_the_informative_score(spark):
    rng = np.random.default_rng(1)
    rows = [(int(y), float(y + rng.normal() * 0.1), float(rng.random())) for y in [0, 1] * 100]
    df = spark.createDataFrame(rows, "y int, good double, noise double")
    best = metrics.best_weights(metrics.weight_grid_auc(df, ["good", "noise"], "y", 4)).first()
    assert best["weights"][0] >= 0.5 and best["auc"] == pytest.approx(1.0)
    assert len(metrics.simplex_grid(3, 10)) == 66


def test_no_shift_between_equal_tables(spark):
    df = spark.createDataFrame([(float(i),) for i in range(200)], "x double")
    assert profile.population_shift(df, df, ["x"]).first()["psi"] == pytest.approx(0.0)
