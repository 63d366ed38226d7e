"""Operators on awkward and empty tables, and beside brute-force versions."""

import math
import re
import warnings
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from creditfeat.llm import attention, class_lm, mixing, near_dedup, onebit, piece_sampling, quality_rules, secrets, sharding, warc
from creditfeat.llm.components import connected_components
from tests.llm.data import documents, empty, labels

SF = entry.SMOKE_DIR
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    w = small(text)
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute_components(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("awkward,chunk_rows", [(True, 512), (False, 2)])
def test_near_duplicates(docs, real, awkward, chunk_rows):
    for df in [docs if awkward else real]:
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want = brute_components([r for r in rows if r[0] is not None])
        got = near_dedup.near_duplicates(df, near_dedup.Sketch(chunk_rows=chunk_rows)).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_nothing(docs):
    assert near_dedup.near_duplicates(empty(docs)).collect() == []


def test_joint_estimate_is_near_the_truth():
    how = near_dedup.Sketch(bands=400, rows=5)
    make = near_dedup.Registers(how)
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = make(pool[:2000]), make(pool[400:2300])
    one = np.ones(1)
    j = near_dedup.joint_estimate((a > b).sum(keepdims=True), (a < b).sum(keepdims=True), 2000 * one, 1900 * one, 2000, how.base)
    assert abs(j[0] - 1600 / 2300) < 0.05


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(60, 61), (70, 70), (99, 0), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in [*range(51), 99]}, 60: 60, 61: 60}


def test_quality_rules(docs):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == docs.count()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        x = r.text or ""
        w = WORD.findall(x)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        lines = [line for line in x.split("\n") if WORD.search(line)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(empty(docs)).collect() == []


def test_quality_rules_split_good_from_poor(spark):
    d = "/root/testdata/sf0.01"
    judged = quality_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet"))
    known = judged.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept for r in known if r.quality == 1]) > 0.99
    assert np.mean([r.kept for r in known if r.quality == 0]) < 0.4


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


def test_secrets(docs):
    import base64

    key = der(0x30, *[der(0x02, bytes([i + 1]) * 40) for i in range(9)])
    assert secrets.is_private_der(key) and not secrets.is_private_der(key[:-1]) and not secrets.is_private_der(key + b"x")
    enc = base64.b64encode(key).decode()
    b64 = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    token = f'{b64(b"{" + b"""\"alg":"HS256"}""")}.{b64(b"""{"sub":"someone"}""")}.abc'
    text = f"x {token} y {enc} z -----BEGIN RSA PRIVATE KEY-----\n{enc[:60]}\n{enc[60:]}\n-----END RSA PRIVATE KEY----- {key.hex()} M{'A' * 60}"
    kinds = [k for k, _, _ in secrets.find_spans(text)]
    assert kinds == ["jwt", "der", "pem", "hex", "hexder"]
    # "Secret: token" is the leftmost match and dropped for its short value, with "token" inside it.
    spans = secrets.find_spans('Secret: token = abcdef ſecret=abcdefg PASSWORD="1234567')
    assert [k for k, _, _ in spans] == ["assign"]
    assert secrets.masked("ab token=abcdef cd", secrets.find_spans("ab token=abcdef cd")) == "ab [REDACTED] cd"
    rows = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert [s.kind for s in rows[12].spans] == ["assign", "access"] and rows[4].spans == []
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert "[REDACTED]" in clean.filter("doc_id = 12").first().text
    assert secrets.scan(empty(docs)).collect() == [] and secrets.redact(empty(docs)).collect() == []


def test_sharding(docs, real):
    for df, shards in ((docs, 16), (real, 16), (real, 3)):
        got = sharding.shard_assignment(df, shards).collect()
        n = df.count()
        assert len(got) == n
        per = Counter(r.shard for r in got)
        assert max(per.values()) - min(per.get(s, 0) for s in range(shards)) <= 1
        for s in per:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
        order = [r.curve_index for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)
    assert sharding.shard_assignment(empty(docs)).collect() == []


@pytest.mark.parametrize("bits,dims", [(1, 2), (3, 2), (2, 3)])
def test_hilbert_steps_to_neighbours(spark, bits, dims):
    cells = F.array(*[F.expr(f"(id div {1 << (bits * i)}) % {1 << bits}") for i in range(dims)])
    rows = spark.range(1 << (bits * dims)).select(cells.alias("c")).select("c", sharding.hilbert_index(F.col("c"), bits, dims).alias("h")).collect()
    walk = sorted(rows, key=lambda r: r.h)
    assert [r.h for r in walk] == list(range(len(rows)))
    assert all(sum(abs(x - y) for x, y in zip(a.c, b.c, strict=True)) == 1 for a, b in zip(walk, walk[1:], strict=False))


def test_write_shards(real, tmp_path):
    sharding.write_shards(real, str(tmp_path / "out"), shards=4, run_rows=20)
    back = real.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == real.count() and back.select("shard").distinct().count() == 4


def test_warc(spark, tmp_path):
    big = "<html>" + "x" * 1200
    rows = [(1, "http://a/ b\r\n", big), (5, "u", big), (3, None, big), (2, "u", "short"), (4, "u", None), (5, "u", big), (None, "u", big), (6, "ü", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))
    plan = warc.plan_records(pages)
    files = warc.write_archives(plan, str(tmp_path / "w"), warc.Archive(roll_bytes=400, sample_bytes=2000))
    got = warc.read_archives(files).collect()
    assert sum(r.records for r in files.collect()) == len(got) == len(rows)
    kinds = Counter((r.record_id, r.record_type, r.refers_to) for r in got)
    last = "<urn:page:5>"
    assert kinds[("<urn:page:1>", "revisit", last)] == kinds[("<urn:page:3>", "revisit", last)] == 1
    assert kinds[("<urn:page:none>", "revisit", last)] == 1 and kinds[(last, "response", None)] == 2
    assert {r.payload_bytes for r in got if r.record_type == "revisit"} == {len(big)}
    assert next(bytes(r.payload) for r in got if r.record_id == "<urn:page:6>") == ("é" * 600).encode()
    assert warc.read_archives(warc.write_archives(empty(plan), str(tmp_path / "e"))).collect() == []


def test_broken_warc():
    good = warc.record_bytes(1, "u", b"abc", 3, "a9993e364706816aba3e25717850c26c9cd0d89d", None, "1970-01-01T00:00:00Z")
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"abc\r\n", b"abd\r\n"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_class_scores(docs, real):
    for df in (docs, real):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5
        c = Counter(w for i, t in rows if fold(i) != 1 for w in [*small(t), b""])
        n, v = sum(c.values()), len(c)
        want = Counter()
        for i, t in rows:
            w = [*small(t), b""]
            base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            want[(i, fold(i) == 1, len(w), sum(c[x] > 0 for x in w), n, round(base, 6))] += 1
        got = class_lm.class_scores(df, class_lm.Brown(block_bytes=3000, top_words=200)).collect()
        assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
        assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert class_lm.class_scores(empty(docs)).collect() == []


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(2)
    counts = np.zeros((13, 13))
    for _ in range(4000):  # units 1-6 are followed by 7-12 and the other way round
        a, b = rng.integers(1, 7), rng.integers(7, 13)
        counts[a, b] += 1
        counts[b, a] += 1
    of = class_lm.exchange(counts, 3, 10)
    assert len({*of[1:7]}) == len({*of[7:]}) == 1 and of[1] != of[7]


def test_quality_scores(docs, spark):
    got = attention.quality_scores(docs, labels(spark)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = attention.quality_scores(docs, empty(labels(spark))).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert attention.quality_scores(empty(docs), labels(spark)).collect() == []


def test_quality_scores_hold_out(spark):
    d = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{d}/labels.parquet")
    scored = attention.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), known)
    rows = scored.filter("held_out").join(known, "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) > 0.98


def test_attention_gradients():
    how = attention.Fit(steps=0, hidden=5, gates=3, encoding=attention.Encoding(bins=4))
    rng = np.random.default_rng(1)
    sizes, y = np.array([1, 3, 2]), np.array([1.0, 0, 1], np.float32)
    x = rng.random((6, how.encoding.width))
    m = {k: v.astype(float) + 0.1 * rng.standard_normal(v.shape) for k, v in attention.fit_bags(x, sizes, y, how).items()}
    loss = lambda: -np.mean(np.log(np.where(y == 1, (p := attention._forward(m, x, sizes)["y"]), 1 - p)))
    for k, grad in attention._gradients(m, x, sizes, y).items():
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        m[k][at] += 1e-5
        up = loss()
        m[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grad[at]) < 1e-4 * max(1, abs(grad[at]))
        m[k][at] += 1e-5


def test_mixing(docs, spark):
    known = mixing.label_domains(labels(spark))
    few = mixing.Mix(steps=3)
    got = mixing.mix(docs, known, how=few).collect()
    assert len(got) == docs.count() and all(r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-6 for r in got)
    assert mixing.mix(empty(docs), known, how=few).collect() == []
    even = mixing.mix(docs, empty(known), how=few).collect()
    assert all(abs(p - 1 / 3) < 1e-6 for r in even for p in r.posteriors)


def test_mixing_meets_targets(spark):
    d = "/root/testdata/sf0.01"
    known = mixing.label_domains(spark.read.parquet(f"{d}/labels.parquet"))
    targets = {"good": 0.7, "poor": 0.2, "toxic": 0.1}
    rows = mixing.mix(spark.read.parquet(f"{d}/documents.parquet"), known, targets, mixing.Mix(anchor=None, steps=40)).collect()
    total = sum(r.n_tokens for r in rows)
    for k, name in enumerate(sorted(targets)):
        assert abs(sum(r.rate * r.n_tokens * r.posteriors[k] for r in rows) / total - targets[name]) < 2e-3
        assert abs(sum(r.copies * r.n_tokens * r.posteriors[k] for r in rows) / total - targets[name]) < 0.05


@pytest.mark.parametrize("met", [True, False])
def test_mixing_gets_as_near_as_least_squares(spark, met):
    """Orthogonal domains, whose least-squares rates are known; the last may have no documents."""
    want = np.array([0.9, *[0.1 / 7] * 7] if met else [*[0.5 / 8] * 8, 0.5])
    p = np.eye(len(want))[:8]
    kind = "doc_id long, n_tokens long, posteriors array<double>"
    members = spark.createDataFrame([(i, 100, x.tolist()) for i, x in enumerate(p)], kind)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        rows = mixing.fit_rates(members, want.tolist(), mixing.Mix(anchor=None), None).collect()
    assert [r.rate for r in sorted(rows)] == pytest.approx(list(8 * want[:8]), abs=1e-4)
    assert any("can't be met" in str(w.message) for w in said) != met


def test_pieces_are_lossless_and_reproducible(docs, spark):
    vocabulary = piece_sampling.load_vocabulary()
    keyed = docs.withColumn("before", F.coalesce("text", F.lit("")))
    ids = piece_sampling.encode(keyed, vocabulary, keep=["before"])
    rows = piece_sampling.decode(ids, vocabulary).collect()
    assert len(rows) == docs.count() and all(r.text == r.before for r in rows)
    again = piece_sampling.encode(docs.repartition(3), vocabulary).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, list(r.ids))
    assert sorted(map(key, again), key=str) == sorted(map(key, ids.collect()), key=str)
    assert piece_sampling.encode(empty(docs), vocabulary).collect() == []


def test_texts_decoded_while_encoding(spark, monkeypatch):
    monkeypatch.setattr(piece_sampling, "LIST_ROWS", 2)
    monkeypatch.setattr(piece_sampling, "CHUNK_UNITS", 5)
    texts = ["one two three", None, "", " \n\t x▁y", "é中 𝄞 a" * 40, "one two three"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id")], "doc_id long, text string").coalesce(1)
    vocabulary = piece_sampling.load_vocabulary()
    both = piece_sampling.encode(docs, vocabulary, decoded=True).collect()
    assert [(r["doc_id"], r["text"]) for r in both] == [(i, t or "") for i, t in [*enumerate(texts), (None, "no id")]]
    later = piece_sampling.decode(piece_sampling.encode(docs, vocabulary), vocabulary).collect()
    assert [r["text"] for r in later] == [r["text"] for r in both]



def test_pieces_are_drawn_by_their_weights():
    vocabulary = piece_sampling.Vocabulary((("▁", 0, 0.0), ("a", 1, 1.0), ("b", 2, 5.0), ("ab", 3, 9.0), ("▁a", 4, 2.0)), tuple(range(10, 266)), 266)
    how = piece_sampling.Sampling(power=1.0, offset=1.0)
    sampler = piece_sampling.Sampler(vocabulary, how)
    n = 20_000
    drawn = Counter()
    for pieces, sizes in sampler.chunks(list(range(n)), ["ab"] * n):
        for row in np.split(pieces, np.cumsum(sizes)[:-1]):
            drawn[tuple(row.tolist())] += 1
    w = {i: 1 / (rank + 1) for _, i, rank in vocabulary.pieces}
    ways = {s: math.prod(w[i] for i in s) for s in [(0, 1, 2), (0, 3), (4, 2)]}
    assert set(drawn) == set(ways)
    for s, weight in ways.items():
        assert abs(drawn[s] / n - weight / sum(ways.values())) < 0.015


def test_lattices_built_at_once_equal_single_ones():
    lattices = piece_sampling.Lattices(piece_sampling.load_vocabulary(), piece_sampling.Sampling())
    units = [" the", "word.", "\n", "▁", " êtreé", " 漢字x", "a" * 48, "b" * 90, " ", " 🙂ab", "equation"]
    for _ in range(3):
        lengths, counts, edges, shares, where = lattices.load(units)
        nodes, ends = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(counts)])
        for unit, k in zip(units, where, strict=True):
            n, c, e, s = lattices.build(unit)
            a, b = nodes[k], nodes[k + 1]
            assert b - a == n and (counts[a:b] == np.frombuffer(c, np.int32)).all()
            a, b = ends[a], ends[b]
            assert (edges[a:b] == np.frombuffer(e, np.int32).reshape(-1, 2)).all()
            assert np.allclose(shares[a:b], np.frombuffer(s), atol=1e-7)


def test_units_seen_once_are_not_kept(monkeypatch):
    """What remains of units that came once is bounded, and what is kept changes no draw."""
    import tracemalloc

    vocabulary = piece_sampling.Vocabulary((("▁", 0, 0.0), ("a", 1, 1.0), ("1", 2, 5.0)), tuple(range(10, 266)), 266)
    lattices = piece_sampling.Lattices(vocabulary, piece_sampling.Sampling())
    lattices.load(["a"])
    tracemalloc.start()
    try:
        for start in range(0, 100_000, 20_000):
            lattices.load([f" {i:06}" for i in range(start, start + 20_000)])
        assert tracemalloc.get_traced_memory()[0] < 4_000_000
    finally:
        tracemalloc.stop()
    texts = [" ".join(f"a{i % 7}1a" for i in range(k, k + 30)) for k in range(40)]
    want = [p.tolist() for p, _ in piece_sampling.Sampler(vocabulary).chunks(range(40), texts)]
    monkeypatch.setattr(piece_sampling, "CACHE_UNITS", 2)
    monkeypatch.setattr(piece_sampling, "SEEN_UNITS", 3)
    monkeypatch.setattr(piece_sampling, "SEEN_BITS", 1)
    assert want == [p.tolist() for p, _ in piece_sampling.Sampler(vocabulary).chunks(range(40), texts)]


def test_one_bit_codes(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.standard_normal(24).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(40)]
    odd = [(500, None), (501, [0.0] * 24), (502, [float("nan")] + [1.0] * 23), (503, [None] + [1.0] * 23), (504, [1.0]), (None, vectors[0][1]), (7, vectors[7][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    got = onebit.search(df, every=50, k=10, how=onebit.Codes(block_rows=64, chunk_rows=4)).collect()
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float32).astype(float)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = np.sqrt(np.square(x - x[q]).sum(axis=1))
        score[q] = np.inf
        want = ids[np.lexsort((ids, score))[:10]].tolist()
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == ids[q]), key=lambda r: r.rank)]
        assert len(mine) == 10
        hits, total = hits + len(set(want) & set(mine)), total + 10
    assert hits / total >= 0.98
    assert onebit.search(df.limit(0)).collect() == []
