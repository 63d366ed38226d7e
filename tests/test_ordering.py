"""Scale forms against the plain forms."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditfeat.operators import folds, ordering, profile


def counts(spark, values):
    df = spark.createDataFrame([(g, float(v)) for g, v in values], "g string, v double")
    return df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))


def sample(n=2000, seed=0):
    rng = np.random.default_rng(seed)
    values = np.concatenate([np.zeros(n // 3), rng.normal(size=n - n // 3).round(2)])
    return [("a" if i % 3 else "b", v) for i, v in enumerate(values)]


@pytest.mark.parametrize("descending", [False, True])
def test_pieces_equal_one_window(spark, descending):
    df = counts(spark, sample())
    plain = ordering.running_totals(df, "v", ["n"], ["g"], descending)
    cut = ordering.running_totals(df, "v", ["n"], ["g"], descending, rows_per_task=7)
    assert sorted(map(tuple, plain.collect())) == sorted(
        map(tuple, cut.select(plain.columns).collect())
    )


def test_pieces_without_groups_and_for_text(spark):
    words = spark.createDataFrame([(f"w{i:03d}",) for i in range(300)], "v string")
    words = words.withColumn("one", F.lit(1))
    cut = ordering.running_totals(words, "v", ["one"], rows_per_task=10).orderBy("v").collect()
    assert [r["cum_one"] for r in cut] == list(range(1, 301))


@pytest.mark.parametrize("rows_per_task", [5, 10**6])
def test_quantiles_interpolate_like_numpy(spark, rows_per_task):
    values, probs = sample(), [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = ordering.weighted_quantiles(
        counts(spark, values), "v", ["n"], probs, ["g"], rows_per_task
    ).collect()
    for group in "ab":
        own = [v for g, v in values if g == group]
        found = {r["prob_index"]: r["q"] for r in got if r["g"] == group}
        assert [found[i] for i in range(len(probs))] == pytest.approx(np.quantile(own, probs))


def test_folds_equal_the_plain_window_and_are_even(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = folds.with_folds(df, "id", "y")
    plain = Window.partitionBy("y").orderBy(folds.shuffle_hash("id"), "id")
    want = df.withColumn("fold", (F.row_number().over(plain) - 1) % 5)
    assert sorted(map(tuple, got.select("id", "y", "fold").collect())) == sorted(
        map(tuple, want.collect())
    )
    sizes = [r["count"] for r in got.where("y = 0").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_rows_without_label_or_key_are_kept(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (None, 1), (4, 0)], "id long, y int")
    assert folds.with_folds(df, "id", "y").count() == 4


def test_split_share_by_class(spark):
    df = spark.range(1000).select("id", (F.col("id") < 100).cast("int").alias("y"))
    got = folds.with_split(df, "id", "y").where("split = 'test'").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 180, 1: 20}


def test_approximate_edges_are_close(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    exact = profile.quantile_edges(df, ["v"]).first()["edges"]
    rough = profile.approx_quantile_edges(df, ["v"]).first()["edges"]
    assert np.allclose(exact, rough, atol=20)


def test_null_groups_stay_at_every_size(spark):
    rows = [(None if i % 3 == 0 else i % 3, float(i), 1) for i in range(300)]
    counts = spark.createDataFrame(rows, "g int, v double, n int")
    whole = ordering.running_totals(counts, "v", ["n"], by=["g"]).select("g", "v", "cum_n")
    cut = ordering.running_totals(counts, "v", ["n"], by=["g"], rows_per_task=20).select("g", "v", "cum_n")
    key = lambda r: (str(r.g), r.v)
    assert sorted(whole.collect(), key=key) == sorted(cut.collect(), key=key)
    assert cut.count() == 300
