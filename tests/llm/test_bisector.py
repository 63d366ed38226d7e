"""Centroid clustering beside a plain version."""

import hashlib

import numpy as np
import pytest

from creditfeat.llm import bisector, queries
from creditfeat.llm.bisector import Clusters
from tests.compare import duck, table_of

SF = "/root/testdata/sf0.001"


def plain(rows, how):
    """(vec_id, cluster, distance) by all distances in Python's integers."""
    vectors = [(i, [int(np.floor(how.scale * float(v))) for v in x]) for i, x in rows]
    key = lambda r: (hashlib.sha256(f"{how.seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted([v for v in vectors if v[0] is not None], key=key)[: how.k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(how.rounds):
        of = [nearest(x)[1] for _, x in vectors]
        for j in range(len(centroids)):
            mine = [x for (_, x), c in zip(vectors, of, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    return sorted([(i, *reversed(nearest(x))) for i, x in vectors], key=repr), centroids


@pytest.mark.parametrize("k,spread", [(5, 3.0), (16, 0.05), (3, 1e7), (40, 1.0)])
def test_equals_all_distances(spark, k, spread):
    """Also with many ties, with components beyond 64-bit sums and with fewer vectors than centroids."""
    how = Clusters(k=k, dims=4)
    rng = np.random.default_rng(k)
    rows = [(i, (rng.standard_normal(4) * spread).round(2).tolist()) for i in range(36)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (50, rows[4][1])]
    odd = [(90, None), (91, [1.0]), (92, [1.0, None, 2.0, 3.0]), (93, [float("nan")] * 4), (94, [float("inf")] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as cluster", "2 as x")
    got = bisector.centroid_clusters(df, how).collect()
    want, centroids = plain(rows, how)
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=repr) == want
    total = sum(d for _, _, d in want)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid == centroids[r.cluster]


def test_of_nothing(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert bisector.centroid_clusters(df, Clusters(dims=2)).collect() == []
    assert bisector.centroid_clusters(df.limit(0), Clusters(dims=2)).collect() == []


def test_query_equals_sql(spark):
    con = duck(SF)
    rel = con.execute(queries.CATALOG.oracles["op12_bisector_clusters"])
    df = queries.op12_bisector_clusters(spark, SF)
    assert table_of(df.columns, df.collect()) == table_of([d[0] for d in rel.description], rel.fetchall())
