"""Forms of keys, base spans by the contract, and rows that earlier versions lost or misjudged."""

import base64
import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditfeat.llm import attention, class_lm, near_dedup, onebit, quality_rules, queries, secrets, sharding
from creditfeat.llm.components import connected_components
from tests.llm.data import documents
from tests.llm.test_operators import der

SF = "/root/testdata/sf0.01"
KEY = der(0x30, *[der(0x02, bytes([i + 1]) * 40) for i in range(9)])
B64 = base64.b64encode(KEY).decode()
LINES = [B64[i : i + 64] for i in range(0, len(B64), 64)]
ARMOUR = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(LINES) + "\n-----END RSA PRIVATE KEY-----"


def ssh_key():
    s = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\x00" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(b"p" * 51) + s(b"q" * 136)


SSH = base64.b64encode(ssh_key()).decode()


@pytest.mark.parametrize(
    "text,kind,span",
    [
        (json.dumps({"private_key": ARMOUR + "\n"}), "pem", "-----BEGIN.*-----END RSA PRIVATE KEY-----"),
        (
            "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
            + base64.b64encode(bytes(range(256)) * 2).decode() + "\n-----END RSA PRIVATE KEY-----",
            "pem", "-----BEGIN.*KEY-----$",
        ),
        ("key:\n  " + "\n  ".join(LINES) + "\nNext line of words", "der", "MII.*" + re.escape(LINES[-1])),
        ("key " + "\\n".join(LINES) + " end", "der", "MII.*" + re.escape(LINES[-1])),
        ("a\\n" + B64 + " b", "der", re.escape(B64)),
        ("ssh " + "\n".join(SSH[i : i + 70] for i in range(0, len(SSH), 70)) + "\nmore", "ssh", "b3Bl.*" + re.escape(SSH[-20:])),
        ("x " + ssh_key().hex() + " y", "hexssh", ssh_key().hex()),
        ("data: " + base64.b64encode(ARMOUR.encode()).decode() + "\n", "pem64", "LS0t.*="),
    ],
)
def test_forms_of_keys(text, kind, span):
    found = [(a, b) for k, a, b in secrets.find_spans(text) if k == kind]
    want = re.search(span, text, re.DOTALL)
    assert found == [want.span()]


@pytest.mark.parametrize("text", [B64[:-4], "MIIC" + B64[4:], ARMOUR.replace("AQEB", "AQEC", 1)[:-40], SSH[:-8], "\n".join(LINES[:-1]) + "\nwords go on"])
def test_broken_keys_are_no_keys(text):
    assert [s for s in secrets.find_spans(text) if s[0] not in secrets.BASE_KINDS] == []


def contract(text):
    """Base spans straight from the contract."""
    spans = []
    for k, (pattern, flags) in enumerate([
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
        (r"AKIA[A-Z0-9]+", 0),
        (r"[0-9a-f]+", 0),
    ]):
        for m in re.finditer(pattern, text, flags):
            if (k == 0 and len(m[2]) >= 6) or (k == 1 and len(m[0]) >= 20) or (k == 2 and len(m[0]) >= 24):
                spans.append((m.start(), k, m.end()))
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(spans)]


def test_base_spans_of_all_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op8_secret_scans(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = contract(t)
        counts = Counter(k for k, _, _ in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(counts[k] for k in ("assign", "access", "hex"))
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 0


def test_null_language_is_judged_by_the_base_rule(spark):
    odd = " ".join("#%&" * 3 for _ in range(400))
    plain = " ".join(f"word{i % 7} and the of" for i in range(600))
    rows = [(1, odd, None), (2, plain, "en"), (3, plain, "en"), (4, odd, "en"), (5, plain, ""), (6, odd, None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i in (1, 6):
        assert got[i].class_distance is None and got[i].word_distance is None and got[i].kept == (not got[i].base_failed)
    assert got[2].class_distance is not None and got[5].class_distance is not None


def test_no_row_is_lost_on_the_way_to_shards(spark, tmp_path):
    df = documents(spark).withColumn("shard", F.lit("own"))
    df = df.union(df.filter("doc_id is null or doc_id = 7"))
    sharding.write_shards(df, str(tmp_path / "out"), shards=4, run_rows=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    names = [c for c in df.columns if c != "shard"]
    assert key(back.select(names).collect()) == key(df.select(names).collect())
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_sources_that_begin_alike_are_told_apart(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("https://example.org/"), F.lpad((F.col("id") * 7 % 64).cast("string"), 2, "0")).alias("source"), F.lit(None).cast("string").alias("lang")
    )
    placed = sharding.shard_assignment(df, 16)
    per = placed.join(df, "doc_id").groupBy("shard").agg(F.count_distinct("source").alias("n")).collect()
    assert max(r.n for r in per) <= 16  # a filter on one source skips nearly all shards


def test_sample_bounds_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert attention.labelled_sample(docs, labels, "quality", 10).count() == 2


def test_recall_on_the_embeddings(spark):
    """All queries of the whole table against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float32).astype(float)
    got = {}
    for r in onebit.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), how=onebit.Codes(block_rows=500, chunk_rows=8)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        score = np.sqrt(np.square(x - x[q]).sum(axis=1))
        score[q] = np.inf
        want = ids[np.lexsort((ids, score))[:10]]
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[2] for m in mine] == pytest.approx([score[ids == m[1]][0] for m in mine])
        hits, total = hits + len({m[1] for m in mine} & {*want.tolist()}), total + 10
    assert hits / total >= 0.98


def test_pairs_inside_a_family_with_a_shared_passage(spark):
    """Texts that share 76 % of their shingles aren't linked; planted pairs among them, near 0.8, come into one cluster."""
    how = near_dedup.Sketch()
    make = near_dedup.Registers(how)
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    rows, pairs = [], []
    for family in range(3):
        passage = draw(760)
        for i in range(120):
            both = draw(136)  # 896 of 1,104 shingles in common: 0.81
            for j in range(2):
                node = family * 1000 + 2 * i + j
                rows.append((node, 1000, make(np.concatenate([passage, both, draw(104)])).tobytes()))
            pairs.append((node - 1, node))
    nodes = spark.createDataFrame(rows, "node long, n_shingles long, registers binary")
    found = near_dedup.candidate_pairs(near_dedup.band_keys(nodes, how), how)
    candidates = {(r.a, r.b) for r in found.collect()}
    clusters = {r.node: r.root for r in connected_components(near_dedup.likely_pairs(found, nodes, how)).collect()}
    assert [p for p in pairs if p[0] not in clusters or clusters[p[0]] != clusters.get(p[1])] == []
    assert len([p for p in pairs if p in candidates]) >= 0.99 * len(pairs)


def test_similar_members_of_large_buckets_meet(spark):
    """Pairs that share one band only, whose bucket's smallest and largest member are like neither of the two."""
    how = near_dedup.Sketch(block_rows=16)
    rng = np.random.default_rng(4)
    sketches = rng.integers(20_000, 60_000, (90, how.bands, how.rows)).astype(np.uint16)
    sketches[:, 0] = sketches[0, 0]
    chain = [(i, i + 1) for i in range(10, 19)]
    pairs = [*chain, *[(i, 90 - i) for i in range(20, 40)]]
    for i, j in pairs:
        sketches[j] = sketches[i]
        sketches[j, 1:, j % how.rows] += np.uint16(1 + j)  # 101 of 125 registers stay
    rows = [(i, 1000, sketches[i].tobytes()) for i in range(90)]
    nodes = spark.createDataFrame(rows, "node long, n_shingles long, registers binary")
    found = near_dedup.candidate_pairs(near_dedup.band_keys(nodes, how), how)
    assert not {(r.a, r.b) for r in found.collect()} & set(pairs)
    got = {r.node: r.root for r in near_dedup.similar_clusters(nodes, how).collect()}
    want = {j: 10 for j in range(10, 20)} | {j: i for i, j in pairs[9:]} | {i: i for i, _ in pairs[9:]}
    assert got == want


def test_windows_are_hashed_by_halves(spark):
    def brute(words):
        starts = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen = Counter(starts)
        return len({j for i, w in enumerate(starts) if seen[w] > 1 for j in range(i, i + 8)})

    rng = random.Random(9)
    lists = [list("abcdefgh"), list("abcdefgh") * 2, ["a"] * 7, ["a"] * 8, ["a"] * 9, ["a"] * 30, [], ["x"]]
    for n in (9, 16, 17, 40, 200):
        lists += [[rng.choice("ab") for _ in range(n)] for _ in range(6)]
        lists.append([f"w{i}" for i in range(n)] + [f"w{i}" for i in range(n // 2)])
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, words array<string>")
    found = rows.select("i", quality_rules._repeat_words(F.col("words"), F.size("words")).alias("n"))
    assert {r.i: r.n for r in found.collect()} == {i: brute(w) for i, w in enumerate(lists)}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert ", 8)" not in plan  # no window is cut out word by word


def test_rare_words_take_the_class_that_raises_the_likelihood_most():
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.4, (40, 40)) * rng.integers(1, 6, (40, 40))
    of = np.concatenate([[0], 1 + rng.integers(0, 4, 39)])

    def likelihood(of):
        member = np.eye(5)[of]
        table = member.T @ counts @ member
        log = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
        return log(table) - log(table.sum(0)) - log(table.sum(1))

    member, words = np.eye(5, dtype=int)[of], np.arange(20, 40)
    other = counts * (1 - np.eye(40, dtype=int))
    table = member.T @ counts @ member
    got = class_lm.best_classes(table, of[words], (other.T @ member)[words], (other @ member)[words], counts[words, words])
    moved = 0
    for w, best in zip(words, got, strict=True):
        tried = [likelihood(np.where(np.arange(40) == w, c, of)) for c in range(1, 5)]
        assert tried[best - 1] >= max(tried) - 1e-6
        moved += best != of[w]
    assert moved


def test_words_of_one_ending_get_classes_of_their_own(spark):
    """Frequent words of two kinds take turns; rare words of both kinds have one ending, so one unit."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(400):
        at = [(kind, rng.integers(5), rng.integers(50), rng.random() < 0.25) for kind in "nv" * 15]
        texts.append((i, " ".join(f"{kind}{rare}xx" if is_rare else f"{kind}{often}" for kind, often, rare, is_rare in at)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    how = class_lm.Brown(top_words=10, endings=8, classes=4, block_bytes=20_000)
    blocks = class_lm.blocked(docs, how)
    top = [f"{kind}{i}" for kind in "nv" for i in range(5)]
    of, table = class_lm.fit_classes(class_lm.unit_bigrams(blocks, top, how), 19, how)
    placed = class_lm.placed_words(class_lm.block_words(blocks, top, of, how), top, of, table, how).collect()
    found = {}
    for r in placed:
        for w, c in zip(bytes(r["words"]).split(b"\n"), bytes(r["classes"]), strict=True):
            assert found.setdefault(w, c) == c  # the same in every block
    kinds = [{c for w, c in found.items() if w[:1] == k and w.endswith(b"xx")} for k in (b"n", b"v")]
    assert not kinds[0] & kinds[1]
    assert sum(sum(r["types"] or []) for r in placed) == len(found)
    rows = class_lm.class_scores(docs, how).collect()
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
