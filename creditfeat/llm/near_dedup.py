"""Near-duplicate documents by SetSketch registers.

1. A document's word shingles give registers: exponentially spaced minima, floor(1 - log_b(x)) of the
   least of exponential variates, truncated to two bytes. They merge by maximum.
2. Bands of registers put similar documents into one bucket. Buckets are linked as stars from two
   members, small ones completely; the links are candidates only.
3. The Jaccard similarity of candidates is estimated from their registers and set sizes by maximum
   likelihood; the plausible ones form clusters. In buckets that no cluster holds whole, all members
   outside the largest cluster are then compared with all members, in blocks.
4. Inside clusters, similarities are confirmed on full shingle sets, likelier pairs first, and pairs
   that are connected already are passed over. Only a spanning forest of links leaves a task.

Documents with equal sets are one node from the start. Clusters are worked on in chunks of bounded
size. Chunks share the cluster's leader; what stays apart from the largest component of a cluster of
several chunks is then set against all its chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditfeat.llm.common import pick, ship_package, stage, worker_state
from creditfeat.llm.components import connected_components

CACHE_WORDS = 300_000
_M64 = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Sketch:
    """``words``: of a shingle; ``percent``: least Jaccard similarity of linked documents;
    ``bands`` of ``rows`` registers each. 25 bands of 5 miss a pair at 0.8 once in 20,000 times.
    ``base``, ``rate``: of the registers. ``small_bucket``: buckets up to this size are compared
    completely from the start. ``likely``: least estimate of a candidate, 4 standard errors below 0.8.
    ``chunk_rows``: documents that a task compares at once; ``block_rows``: sketches of a large bucket."""

    words: int = 4
    percent: int = 80
    bands: int = 25
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    small_bucket: int = 12
    likely: float = 0.66
    chunk_rows: int = 512
    block_rows: int = 2048
    seed: int = 3

    @property
    def registers(self) -> int:
        return self.bands * self.rows


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M64[1]
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Distinct shingles of texts (UTF-8) as sorted 64-bit hashes."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, _Hashes()
        self.factors = [_M64[i % 4] * np.uint64(2 * (i // 4) + 1) for i in range(words)]

    def __call__(self, text: bytes | None) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = _Hashes()
        words = (text or b"").lower().split()
        ids = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if len(ids) == 0:
            return ids
        width = min(self.words, len(ids))
        n = len(ids) - width + 1
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = _mixed(out + ids[i : i + n] * self.factors[i])
        return np.unique(out)


def worker_shingler(words: int) -> Shingler:
    return worker_state(("shingles", words), lambda key: Shingler(key[1]))


class Registers:
    def __init__(self, how: Sketch) -> None:
        rng = np.random.default_rng(how.seed)
        self.how = how
        self.factor = rng.integers(0, 1 << 32, how.registers, np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, how.registers, np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.how.registers, 0xFFFFFFFF, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        for at in range(0, len(short), 2048):
            h = short[at : at + 2048, None] * self.factor
            h += self.shift
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0x297A2D39)
            np.minimum(least, h.min(axis=0), out=least)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / self.how.rate
        k = np.floor(1 - np.log(x) / np.log(self.how.base))
        return np.clip(k, 0, 65535).astype(np.uint16)


def sketch(docs: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """doc_id, ``text_key``, ``n_shingles``, ``node`` (equal for equal sets) and ``registers`` of every
    row; without words the last two are null."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, registers = worker_shingler(how.words), Registers(how)
        for batch in batches:
            sizes, nodes, kept = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                s = shingler(text.as_py())
                sizes.append(len(s))
                whole = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
                nodes.append(int.from_bytes(whole, "little", signed=True) if len(s) else None)
                kept.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "node", "registers"],
            )

    kind = "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, registers binary"
    return _keyed(docs).select("doc_id", "text_key", "text").mapInArrow(run, kind)


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="bigint", text="string").withColumn("text_key", F.xxhash64("text"))


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), width)


def band_keys(nodes: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """(key, node, other, later), one row for each band; the key is a hash of the band's registers and number,
    ``other`` and ``later`` are the keys of the two bands after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = _unpacked(batch.column(1), how.registers).astype(np.uint64)
            k = k.reshape(len(k), how.bands, how.rows)
            key = np.broadcast_to(np.arange(how.bands, dtype=np.uint64), k.shape[:2]).copy()
            for i in range(how.rows):
                key = _mixed(key * _M64[0] + k[:, :, i] + np.uint64(1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64).ravel()),
                    pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), how.bands)),
                    *[pa.array(np.roll(key, -i, axis=1).view(np.int64).ravel()) for i in (1, 2)],
                ],
                ["key", "node", "other", "later"],
            )

    kind = "key bigint, node bigint, other bigint, later bigint"
    return nodes.select("node", "registers").mapInArrow(run, kind)


def _bucketed(bands: DataFrame) -> DataFrame:
    """``bands`` with the smallest and largest node and the size of their buckets, without lone nodes."""
    hubs = (
        bands.groupBy("key")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"))
        .filter("size > 1")
    )
    return stage(bands.join(hubs, "key"), "buckets")


def _bucket_pairs(members: DataFrame, how: Sketch) -> DataFrame:
    stars = members.select(F.explode(F.array("low", "high")).alias("hub"), "node")
    small = members.filter(F.col("size").between(3, how.small_bucket)).select("key", "node")
    other = small.select("key", F.col("node").alias("hub"))
    return stars.union(small.join(other, "key").select("hub", "node"))


def candidate_pairs(bands: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """Distinct (a, b), a < b: of every bucket the stars of its smallest and largest node, of small
    buckets all pairs. Members of larger buckets are dealt once more, by the band together with each of
    two others, where those that are alike beyond what the whole bucket shares are few. The number of
    pairs grows with the rows, not with their square; ``missed_links`` has the rest."""
    return _candidates(_bucketed(bands), how)


def _candidates(members: DataFrame, how: Sketch) -> DataFrame:
    finer = F.array(F.xxhash64("key", "other"), F.xxhash64("key", "later"))
    large = members.filter(F.col("size") > how.small_bucket).select(F.explode(finer).alias("key"), "node")
    pairs = _bucket_pairs(members, how).union(_bucket_pairs(_bucketed(large), how)).filter("hub <> node")
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def joint_estimate(
    above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, total: int, base: float
) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the numbers of registers that are larger in one or
    the other sketch, given both set sizes, on a grid of 1/128."""
    share = size_a / (size_a + size_b)
    most = np.minimum(size_a, size_b) / np.maximum(size_a, size_b)
    best, at = np.full(len(share), -np.inf), np.zeros(len(share))
    equal = total - above - below
    tiny = 1e-9

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    for j in np.linspace(0, 1, 129):
        p = np.clip(chance(share - (1 - share) * j), tiny, 1)
        q = np.clip(chance((1 - share) - share * j), tiny, 1)
        fit = above * np.log(p) + below * np.log(q) + equal * np.log(np.clip(1 - p - q, tiny, 1))
        better = (fit > best) & (j <= most + 1 / 128)
        best, at = np.where(better, fit, best), np.where(better, j, at)
    return at


def likely_pairs(pairs: DataFrame, nodes: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """The candidates whose estimate reaches ``likely``."""
    near = how.percent / 100
    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    joined = pairs.join(a, "a").join(b, "b")
    # Sets whose sizes differ more can't be that similar.
    joined = joined.filter(F.least("na", "nb") >= near * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_unpacked(batch.column(i), how.registers) for i in (4, 5))
            sizes = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3)]
            j = joint_estimate((x > y).sum(1), (x < y).sum(1), *sizes, how.registers, how.base)
            keep = pa.array(j >= how.likely)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"]
            )

    columns = joined.select("a", "b", "na", "nb", "ra", "rb")
    return columns.mapInArrow(run, "a bigint, b bigint")


def missed_links(members: DataFrame, nodes: DataFrame, clusters: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """Links (a, b) between the roots of clusters (node, root), so that no two members of a large bucket are apart whose
    registers agree as ``forest`` asks. Members of a bucket's largest cluster are together already, so
    only the others are compared with all members. A task sets one block of them against another and
    returns a spanning forest of what it links."""
    large = members.filter(F.col("size") > how.small_bucket).select("key", "node").join(clusters, "node", "left")
    large = stage(large.withColumn("root", F.coalesce("root", "node")), "large-buckets")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    per_root = large.groupBy("key", "root").agg(F.count("*").alias("n"), *marks)
    per_key = per_root.groupBy("key").agg(
        F.max(F.struct("n", "root")).alias("most"),
        F.sum("n").alias("all"),
        *[F.bit_xor(f"mark{i}").alias(f"mark{i}") for i in range(2)],
    )
    # Bands often hold the same members; one of such buckets is enough.
    blocks = lambda n: F.ceil(n / how.block_rows).cast("int")
    opened = per_key.filter(F.col("all") > F.col("most.n")).groupBy("mark0", "mark1", "all").agg(
        F.min(F.struct("key", "most")).alias("of")
    ).select(
        "of.key",
        F.col("of.most.root").alias("largest"),
        blocks(F.col("all") - F.col("of.most.n")).alias("parts"),
        blocks(F.col("all")).alias("chunks"),
    )
    rows = large.join(stage(opened, "open-buckets"), "key").withColumn("apart", F.col("root") != F.col("largest"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
    columns = ["key", "node", "root", "apart"]
    left = rows.filter("apart").select(*columns, F.lit(True).alias("left"), own("parts").alias("part"), every("chunks").alias("chunk"))
    right = rows.select(*columns, F.lit(False).alias("left"), own("chunks").alias("chunk"), every("parts").alias("part"))
    met = left.unionByName(right).join(nodes.select("node", "n_shingles", "registers"), "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_left = pdf["left"].to_numpy()
        few, block = pdf[is_left], pdf[~is_left]
        mine, theirs = (np.frombuffer(b"".join(x["registers"]), np.uint16).reshape(-1, how.registers) for x in (few, block))
        by_register = np.ascontiguousarray(theirs.T)
        nodes, sizes, apart = (block[c].to_numpy() for c in ("node", "n_shingles", "apart"))
        names, at = np.unique(np.concatenate([few["root"], block["root"]]), return_inverse=True)
        own, at, parent = at[: len(few)], at[len(few) :], np.arange(len(names))

        def root(g: int) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        links = []
        for first in range(0, len(few), 64):
            part = slice(first, first + 64)
            node, size, r = few["node"].to_numpy()[part, None], few["n_shingles"].to_numpy()[part, None], own[part]
            same = np.zeros((len(r), len(block)), np.uint16)
            for k in range(how.registers):
                same += by_register[k] == mine[part, k, None]
            # Two members apart meet twice, once in each order.
            ok = (same >= how.likely * how.registers) & (at != r[:, None]) & (~apart | (nodes > node))
            ok &= 100 * np.minimum(sizes, size) >= how.percent * np.maximum(sizes, size)
            i, j = np.nonzero(ok)
            for g, h in np.unique(np.stack([r[i], at[j]], axis=1), axis=0).tolist():
                a, b = root(g), root(h)
                if a != b:
                    parent[a] = b
                    links.append((int(names[g]), int(names[h])))
        return _frame(links)

    return met.groupBy("key", "part", "chunk").applyInPandas(run, "a bigint, b bigint")


def similar_clusters(nodes: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """(node, root) of the nodes that candidates with a likely similarity connect."""
    members = _bucketed(stage(band_keys(nodes, how), "bands"))
    clusters = connected_components(likely_pairs(_candidates(members, how), nodes, how))
    missed = stage(missed_links(members, nodes, clusters, how), "missed")
    if missed.isEmpty():
        return clusters
    moved = stage(connected_components(missed), "moved")  # a node of no cluster is its own root
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    merged = clusters.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return merged.union(moved).distinct()


def _with_sets(docs: DataFrame, members: DataFrame, how: Sketch) -> DataFrame:
    """(cluster, node, registers, shingles) of the members, read from the documents that stand for
    them. ``members``: cluster, node, doc_id, text_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, registers = worker_shingler(how.words), Registers(how)
        for batch in batches:
            sets = [shingler(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["cluster", "node", "registers", "shingles"],
            )

    # Members grow with the corpus and have no size bound, so they are never broadcast.
    # Rows that repeat an id and a text are one member: only one of them goes on.
    joined = (
        _keyed(docs)
        .join(members.hint("merge"), ["doc_id", "text_key"])
        .groupBy("cluster", "node")
        .agg(F.first("text").alias("text"))
    )
    return joined.mapInArrow(run, "cluster bigint, node bigint, registers binary, shingles binary")


def forest(
    nodes: np.ndarray, groups: np.ndarray, registers: np.ndarray, sets: list[np.ndarray], left: np.ndarray, how: Sketch
) -> list[tuple[int, int]]:
    """Links between groups of nodes that are apart, by confirmed pairs with a node in ``left``."""
    parent: dict[int, int] = {int(g): int(g) for g in groups}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    sizes = np.array([len(s) for s in sets])
    found: list[np.ndarray] = []
    for i in np.flatnonzero(left):
        size_ok = 100 * np.minimum(sizes, sizes[i]) >= how.percent * np.maximum(sizes, sizes[i])
        others = np.flatnonzero(size_ok & (groups != groups[i]) & ~(left & (np.arange(len(left)) <= i)))
        if len(others):
            same = (registers[others] == registers[i]).sum(axis=1)
            ok = same >= how.likely * how.registers
            if ok.any():
                found.append(np.stack([same[ok], np.full(ok.sum(), i), others[ok]]))
    links = []
    if found:
        pairs = np.concatenate(found, axis=1)
        for _, i, j in pairs[:, np.argsort(-pairs[0], kind="stable")].T.tolist():
            a, b = root(int(groups[i])), root(int(groups[j]))
            if a == b:
                continue
            union = len(np.unique(np.concatenate([sets[i], sets[j]])))
            both = sizes[i] + sizes[j] - union
            if 100 * both >= how.percent * union:
                parent[a] = b
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def _loaded(pdf: pd.DataFrame, how: Sketch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    registers = np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(-1, how.registers)
    return pdf["node"].to_numpy(), registers, [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]


def _frame(links: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def confirmed_links(rows: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """Links (a, b) on full sets that connect what is similar inside the clusters. ``rows``: cluster,
    node, registers, shingles."""
    rows = stage(rows, "sets")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.min("node").alias("leader"))
    chunks = F.ceil(F.col("size") / how.chunk_rows).cast("int")
    sizes = stage(sizes.withColumn("chunks", chunks), "sizes")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    placed = rows.join(sizes, "cluster").withColumn("chunk", own)
    leaders = placed.filter((F.col("node") == F.col("leader")) & (F.col("chunks") > 1))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    columns = ["cluster", "chunk", "node", "registers", "shingles"]
    first = placed.select(columns).union(leaders.withColumn("chunk", everywhere).select(columns))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        nodes, registers, sets = _loaded(pdf, how)
        return _frame(forest(nodes, nodes, registers, sets, np.ones(len(nodes), bool), how))

    links = stage(first.groupBy("cluster", "chunk").applyInPandas(within, "a bigint, b bigint"), "forest")
    if sizes.filter("chunks > 1").isEmpty():
        return links
    # Clusters of several chunks: what isn't in the largest component is set against all chunks.
    roots = connected_components(links)
    many = placed.filter("chunks > 1").join(roots, "node", "left")
    many = stage(many.withColumn("root", F.coalesce("root", "node")), "large-clusters")
    per_root = many.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "root")
    largest = per_root.withColumn("place", F.row_number().over(order)).filter("place = 1")
    largest = largest.select("cluster", F.col("root").alias("largest"))
    columns = ["cluster", "node", "root", "registers", "shingles"]
    apart = many.join(largest, "cluster").filter("root <> largest")
    apart_sizes = apart.groupBy("cluster").agg(F.ceil(F.count("*") / how.chunk_rows).cast("int").alias("parts"))
    left = apart.join(apart_sizes, "cluster").select(
        *columns, F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("part"), everywhere.alias("chunk")
    )
    left = stage(left, "apart")  # so that the two sides of the cogroup have columns of their own
    right = many.join(apart_sizes, "cluster").select(
        *columns, "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )

    def across(few: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(few):
            return _frame([])
        pdf = pd.concat([few, block]).drop_duplicates("node")
        nodes, registers, sets = _loaded(pdf, how)
        is_left = np.isin(nodes, few["node"].to_numpy())
        return _frame(forest(nodes, pdf["root"].to_numpy(), registers, sets, is_left, how))

    keys = ["cluster", "part", "chunk"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(across, "a bigint, b bigint")
    return links.union(stage(met, "forest"))


def near_duplicates(docs: DataFrame, how: Sketch = Sketch(), keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text); ``keyed`` adds
    ``text_key`` and ``node``, hashes of the text and of its set (null without words).

    Null and empty texts, and texts of white space, have no shingles, are linked with nothing and
    kept. Rows with a null id bear on nothing and get a null component and kept. Repeated rows get
    equal results. Further columns are ignored; an empty table gives an empty result.
    """
    marked = stage(sketch(docs, how), "sketches")
    known = marked.filter("node is not null and doc_id is not null")
    nodes = stage(
        known.groupBy("node").agg(
            F.min(F.struct("doc_id", "text_key", "n_shingles", "registers")).alias("first")
        ).select("node", "first.*"),
        "nodes",
    )
    members = nodes.join(similar_clusters(nodes, how), "node").select(
        F.col("root").alias("cluster"), "node", "doc_id", "text_key"
    )
    links = confirmed_links(_with_sets(docs, stage(members, "members"), how), how)
    roots = connected_components(links)
    named = nodes.select("node", "doc_id").join(roots, "node")
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    linked = named.join(lowest, "root").select("node", "component")
    of_node = stage(
        nodes.select("node", F.col("doc_id").alias("_first")).join(linked, "node", "left"), "components"
    )
    joined = marked.select("doc_id", "n_shingles", "node", "text_key").join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "_first", "doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        *(["text_key", "node"] if keyed else []),
    )


def without_near_duplicates(docs: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id and, of rows that share it,
    one by hash of the text.

    Rows are told apart by id and text, so where an id has several texts each is judged by itself. Rows without an
    id are grouped by equal sets. Texts without words are groups of their own, one row for each id."""
    found = near_duplicates(docs, how, keyed=True)
    group = [
        F.col("component_id"),
        F.when(F.col("component_id").isNull() | F.col("node").isNull(), F.coalesce("node", "text_key")).alias("own"),
        F.col("node").isNull().alias("empty"),
    ]
    first = found.select("doc_id", "text_key", *group).groupBy("component_id", "own", "empty")
    kept = first.agg(F.min(F.struct("doc_id", "text_key")).alias("row")).select("row.*")
    named = {"_id": F.coalesce("doc_id", F.lit(0).cast("bigint")), "_null": F.col("doc_id").isNull(), "_text": F.col("text_key")}
    keys = stage(kept.select(*[c.alias(n) for n, c in named.items()]), "kept")
    text = F.xxhash64(F.col("text").cast("string"))
    id_ = F.col("doc_id").cast("bigint")
    rows = docs.withColumns({"_id": F.coalesce(id_, F.lit(0).cast("bigint")), "_null": id_.isNull(), "_text": text})
    # Rows that repeat an id and text lie in one partition of the join; one of them stays.
    return rows.join(keys.hint("merge"), list(named)).dropDuplicates(list(named)).select(docs.columns)
