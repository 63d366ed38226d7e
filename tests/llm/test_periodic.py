"""Periodic runs beside a brute-force version."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from creditfeat.llm import periodic, queries
from tests.llm.data import documents, empty

SF = "/root/testdata/sf0.001"


def brute(w, times=4, least=6):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(rng.randint(1, 6)):
        letters, t = rng.choice([1, 2, 3, 10, 1000]), []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, rng.choice([3, 12, 40, 150])))]
            t += unit * rng.randint(1, 8) + unit[: rng.randint(0, len(unit))]
        out.append(np.array(t, np.int64))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    some = texts(seed)
    assert periodic.find_runs(some) == [brute(t.tolist()) for t in some]


def test_runs_of_many_periods_and_a_longer_threshold():
    t = [np.array(([*range(p)] * 7)[: 6 * p + 3]) for p in range(1, 70)]
    how = periodic.Periods(times=6)
    assert periodic.find_runs(t, how) == [brute(x.tolist(), 6) for x in t]
    assert all(periodic.find_runs(t, how)[p - 1] == [(0, 6 * p + 3, p)] for p in range(3, 70))
    with pytest.raises(ValueError):
        periodic.Periods(times=3)


def test_small_periods_come_from_regular_regions():
    """A highly periodic text has no synchronising position at a scale of four periods or more."""
    x = np.append(np.array([0, 1] * 200), 9)
    assert len(periodic.proposals(x, 8, np.array([[0, 400]]))) == 0
    assert periodic.find_runs([x]) == [[(0, 400, 2)]]


def test_scales_propose_long_periods():
    unit = np.random.default_rng(1).integers(0, 10**6, 37)
    x = np.concatenate([np.arange(10**6, 10**6 + 50), np.tile(unit, 5)])
    assert 37 in periodic.proposals(x, 32, np.zeros((0, 2), np.int64))[:, 1]


def test_awkward_and_empty(spark, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK_WORDS", 500)
    df = documents(spark)
    rows = df.select("doc_id", "text").collect()
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()), key=repr)
    want = []
    for r in rows:
        w = (r.text or "").encode().split()
        runs = brute(w)
        want.append((r.doc_id, runs, collapsed(w, runs).decode()))
    assert got == sorted(want, key=repr) and any(runs for _, runs, _ in want)
    assert periodic.periodic_runs(empty(df)).collect() == []
    made = sorted(((r.doc_id, [x.decode() for x in (r.text or "").encode().split()]) for r in periodic.with_repeats(df).collect()), key=repr)
    assert made == sorted([(r.doc_id, [x.decode() for x in planted(r.doc_id, r.text)]) for r in rows], key=repr)


def test_query_on_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        w, mine = planted(r.doc_id, r.text), got[r.doc_id]
        runs = brute(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (mine.n_runs, mine.start, mine.length, mine.period) == (len(runs), *best)
        assert mine.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert mine.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert mine.collapsed_sha256 == hashlib.sha256(collapsed(w, runs)).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 5
