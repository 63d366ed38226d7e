"""The neighbour search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditfeat.operators import knn
from creditfeat.operators import neighbour_search as ns

KS = [3, 10]
SCHEMA = "key long, y int, fold int, x array<double>"


def rows(n, dims, seed, lattice=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    if lattice:
        x = rng.integers(0, 3, size=(n, dims)).astype(float)
    x[: n // 3] = x[0]  # a third of all rows share one vector
    return [
        (int(i), int(rng.integers(0, 2)), int(i % 5), [float(v) for v in x[i]]) for i in range(n)
    ]


def brute(train, queries, fold_of, ks, drawn=None):
    """Rates in the metric of fold_of(query), excluding that fold; ``drawn``: keys searched."""
    out = {}
    for q in queries:
        f = fold_of(q)
        ref = [t for t in train if t[2] != f]
        pts = np.array([t[3] for t in ref])
        mean, scale = pts.mean(0), pts.std(0)
        scale[scale == 0] = 1
        d = (((pts - mean) / scale - (np.array(q[3]) - mean) / scale) ** 2).sum(1).round(9)
        order = sorted(range(len(ref)), key=lambda i: (d[i], ref[i][0]))
        order = [i for i in order if drawn is None or ref[i][0] in drawn]
        out[q[0]] = [np.mean([ref[i][1] for i in order[:k]]) for k in ks]
    return out


def fitted(spark, train, fold, **kw):
    df = spark.createDataFrame(train, SCHEMA)
    return df, knn.NeighbourRates.fit(df, F.col("x"), "key", "y", KS, fold, **kw)


def rates(r):
    return [r["knn_oof_3"], r["knn_oof_10"]]


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 20)
    monkeypatch.setattr(knn, "PLACE_ROWS", 64)


@pytest.mark.parametrize("lattice", [False, True])
@pytest.mark.parametrize("held", [knn.SCALED_BYTES, 0])
def test_out_of_fold_rates_match_brute_force(spark, lattice, held, monkeypatch):
    monkeypatch.setattr(knn, "SCALED_BYTES", held)
    train = rows(240, 4, 1, lattice)
    df, model = fitted(spark, train, "fold")
    got = model.transform(df, F.col("x"), "key", "oof").collect()
    want = brute(train, train, lambda q: q[2], KS)
    assert len(got) == len(train)
    for r in got:
        assert rates(r) == pytest.approx(want[r["key"]])


def test_new_rows(spark):
    train, fresh = rows(150, 3, 2), [(1000 + r[0], *r[1:]) for r in rows(40, 3, 3)]
    _, model = fitted(spark, train, "fold")
    new = spark.createDataFrame(fresh, SCHEMA).drop("fold")
    full = model.transform(new, F.col("x"), "key", "full_fit").collect()
    want = brute(train, fresh, lambda q: None, KS)
    for r in full:
        assert rates(r) == pytest.approx(want[r["key"]])
    mean = model.transform(new, F.col("x"), "key", "fold_mean").collect()
    per_fold = [brute(train, fresh, lambda q, f=f: f, KS) for f in range(5)]
    for r in mean:
        assert r["knn_oof_10"] == pytest.approx(np.mean([p[r["key"]][1] for p in per_fold]))


def test_neighbour_lists(spark):
    train = rows(120, 3, 5)
    df, model = fitted(spark, train, None)
    got = model.neighbours(df, F.col("x"), "key", "full_fit").collect()
    assert len(got) == len(train) * KS[-1]
    pts = np.array([t[3] for t in train])
    z = (pts - pts.mean(0)) / pts.std(0)
    for r in got:
        d = ((z - z[r["key"]]) ** 2).sum(1).round(9)
        want = sorted(range(len(train)), key=lambda i: (d[i], i))[r["place"] - 1]
        assert (r["neighbour"], r["label"]) == (want, train[want][1])
        assert r["distance"] == pytest.approx(np.sqrt(d[want]))


def test_fewer_rows_than_neighbours(spark):
    train = rows(6, 2, 4)
    df, model = fitted(spark, train, None)
    got = model.transform(df, F.col("x"), "key", "full_fit").collect()
    share = np.mean([t[1] for t in train])
    assert all(r["knn_oof_10"] == pytest.approx(share) for r in got)


def test_bounded_reference(spark):
    train = rows(300, 3, 6)
    df, model = fitted(spark, train, "fold", reference_rows=100)
    drawn = {r["key"] for r in model.reference.collect()}
    assert 60 < len(drawn) < 140
    want = brute(train, train, lambda q: q[2], KS, drawn)
    for r in model.transform(df, F.col("x"), "key", "oof").collect():
        assert rates(r) == pytest.approx(want[r["key"]])


def test_rows_that_are_no_reference(spark):
    train = rows(100, 3, 7)
    odd = [
        (500, None, 1, [0.1, 0.2, 0.3]),
        (501, 1, None, [0.1, 0.2, 0.3]),
        (502, 1, 2, None),
        (None, 1, 3, [0.5, 0.5, 0.5]),
        (7, 1, 2, None),  # the second row of this key
    ]
    df, model = fitted(spark, train + odd, "fold")
    assert model.rows == len(train)
    got = model.transform(df, F.col("x"), "key", "oof").collect()
    assert len(got) == len(train) + len(odd)
    for r in got:
        if r["x"] is None or r["fold"] is None:
            assert rates(r) == [None, None]
        else:
            q = (r["key"], r["y"], r["fold"], r["x"])
            assert rates(r) == pytest.approx(brute(train, [q], lambda q: q[2], KS)[r["key"]])


def test_empty_reference(spark):
    _, model = fitted(spark, [], "fold")
    df = spark.createDataFrame(rows(5, 2, 8), SCHEMA)
    for mode in ("oof", "fold_mean", "full_fit"):
        got = model.transform(df, F.col("x"), "key", mode).collect()
        assert len(got) == 5 and all(rates(r) == [None, None] for r in got)


def test_frequent_vector_leaves_the_centres_apart(spark):
    train = [(i, i % 2, i % 5, [float(i), float(i % 7)]) for i in range(400)]
    train += [(1000 + i, 1, i % 5, [3.0, 3.0]) for i in range(400)]
    _, model = fitted(spark, train, "fold")
    cells = model._broadcast().value
    assert len(np.unique(cells.centres, axis=0)) == len(cells.centres) >= 20
    # Row 3 has that vector too and is one of those kept in its fold.
    assert len(cells.keys) == 399 + 5 * KS[-1]


def test_join_searches_all_rows_in_blocks(spark):
    train = rows(300, 3, 9)
    train[7] = (8, *train[7][1:])  # a repeated key: both rows have a list
    df = spark.createDataFrame(train, SCHEMA)
    got = knn.nearest_rows(df, F.col("x"), "key", "y", 10, block_rows=70).collect()
    assert len(got) == 10 * len(train)
    pts = np.array([t[3] for t in train])
    z = (pts - pts.mean(0)) / pts.std(0)
    want = []
    for i, t in enumerate(train):
        d = ((z - z[i]) ** 2).sum(1).round(9)
        order = sorted(range(len(train)), key=lambda j: (d[j], train[j][0], train[j][1]))[:10]
        want += [(t[0], p + 1, train[j][0], round(float(np.sqrt(d[j])), 6), train[j][1]) for p, j in enumerate(order)]
    assert sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got) == sorted(want)


def test_knn_join_draws_nothing(spark, monkeypatch):
    import __spark_entry__ as entry

    one = entry.queries()["knn_join"](spark, entry.SMOKE_DIR).collect()
    monkeypatch.setattr(knn.NeighbourRates.fit.__func__, "__defaults__", (None, 5, 60))
    monkeypatch.setattr(knn.nearest_rows, "__defaults__", (200,))
    many = entry.queries()["knn_join"](spark, entry.SMOKE_DIR).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_repeated_keys_keep_the_bound(spark):
    train = [(1, i % 2, i % 5, [float(i), float(i % 7)]) for i in range(600)]  # one key
    train += [(2, 1, 3, [4.0, 4.0])] * 600  # equal rows
    _, model = fitted(spark, train, "fold", reference_rows=100)
    assert 20 < model.reference.count() < 100 + KS[-1]


@pytest.mark.parametrize("dims, far", [(2, 0.0), (40, 0.0), (5, 1e6)])
def test_search_takes_exact_distances_of_few_rows(dims, far, monkeypatch):
    """Rows are chosen by bounds in single precision; exact distances are left to those that may be among the k."""
    rng = np.random.default_rng(dims)
    points = rng.normal(size=(9000, dims)).round(2) + far
    points[::3] = points[0]
    keys = rng.permutation(9000)
    where = np.sort(rng.integers(0, 20, 9000))
    starts = np.searchsorted(where, np.arange(21))
    centres = np.array([points[a:b].mean(0) for a, b in zip(starts, starts[1:], strict=False)])
    radii = np.array([ns.distances(points[starts[c] : starts[c + 1]], centres[c : c + 1]).max() for c in range(20)]) + far * 1e-6
    ref = ns.Reference(points, keys, np.ones(9000, int), starts, centres, radii)
    q = points[rng.permutation(9000)[:70]] + rng.normal(size=(70, dims)).round(1)
    seen = []
    exact = ns._merge
    monkeypatch.setattr(ns, "SPAN", 512)
    monkeypatch.setattr(ns, "_merge", lambda *a: seen.append(a[2].shape[1]) or exact(*a))
    dist, near, _ = ns.nearest(q, ref, 50)
    d = ((points[None] - q[:, None]) ** 2).sum(2).round(9)
    for i in range(len(q)):
        order = np.lexsort((keys, d[i]))[:50]
        assert near[i].tolist() == keys[order].tolist()
        assert np.allclose(dist[i], d[i][order], atol=1e-9)
    if dims == 40:
        assert max(seen) < 3200  # equal vectors tie; of the others hardly more than k


def test_a_task_holds_one_scaled_copy_of_a_whole_reference():
    assert 64 * 8 * knn.REFERENCE_ROWS < knn.SCALED_BYTES < 2 * 64 * 8 * knn.REFERENCE_ROWS


def test_leak_report_runs_one_search_at_a_time(spark, tmp_path, monkeypatch):
    from creditfeat.catalog import neighbours

    found = []
    report = neighbours.quality.leak_report
    monkeypatch.setattr(neighbours.quality, "leak_report", lambda df, *a: found.append(df) or report(df, *a))
    made = [(int(i), [float(i % 7), float(i % 5)], int(i % 6)) for i in range(60)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    neighbours.leak_report_neighbours(spark, str(tmp_path))
    plan = found[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("lattice", [False, True])
def test_every_labelled_row_is_searched_part_by_part(spark, lattice, monkeypatch):
    monkeypatch.setattr(knn, "REFERENCE_ROWS", 50)
    train = rows(240, 4, 11, lattice) + [(7000, 1, 2, [0.0] * 4)] * 120  # equal in all: they are dealt too
    df, model = fitted(spark, train, "fold")
    sizes = [len(model._broadcast(p).value.keys) for p in model._parts()]
    assert model.reference.count() == len(train) and len(sizes) == 8 and max(sizes) < 100
    want = brute(train, train, lambda q: q[2], KS)
    for r in model.transform(df, F.col("x"), "key", "oof").collect():
        assert rates(r) == pytest.approx(want[r["key"]])
    whole = brute(train, train, lambda q: None, KS)
    for r in model.transform(df, F.col("x"), "key", "full_fit").collect():
        assert rates(r) == pytest.approx(whole[r["key"]])


def test_nothing_is_drawn_unless_a_caller_asks(spark):
    n = 2 * knn.REFERENCE_ROWS + 1000
    df = spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("y"), F.array(F.rand(3)).alias("x"))
    model = knn.NeighbourRates.fit(df, F.col("x"), "key", "y", KS)
    assert model.rows == n and model.reference.count() == n and len(model._parts()) == 3


def test_parts_give_the_lists_of_the_whole():
    rng = np.random.default_rng(3)
    points, q = rng.normal(size=(3000, 6)).round(1), rng.normal(size=(300, 6)).round(1)
    keys, labels = rng.permutation(3000), rng.integers(0, 2, 3000)

    def reference(use):
        z = points[use]
        middle = z.mean(axis=0, keepdims=True)
        return ns.Reference(z, keys[use], labels[use], np.array([0, len(z)]), middle, ns.distances(z, middle).max(axis=0))

    whole, found = ns.nearest(q, reference(np.arange(3000)), 40), None
    for use in (np.arange(0, 25), np.arange(25, 25), np.arange(25, 1200), np.arange(1200, 3000)):
        found = ns.nearest(q, reference(use) if len(use) else ns.Reference(points[:0], keys[:0], labels[:0], np.zeros(1, int), points[:0], np.zeros(0)), 40, found)
    for a, b in zip(whole, found, strict=True):
        assert np.array_equal(a, b)
