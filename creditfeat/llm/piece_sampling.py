"""SentencePiece encoding by sampling, and lossless decoding.

The pieces of a text form a lattice. Forward filtering sums the weights of all ways to each
character, backward sampling draws the pieces from the end, each way with its share of the total. No
piece crosses the start of a word, so the lattice of a text is a chain of small ones: those of
distinct words are built once, and all occurrences in a chunk are drawn together. Every draw comes
from the row's key, the word's place and the character, so a text is segmented alike whatever batch,
task or attempt it is in.

Weights follow a piece's rank in the vocabulary: (rank + offset) ** -power. Nothing is normalised;
characters that are no piece become byte pieces, so decoding gives the very text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from creditfeat.llm.common import ship_package, worker_state

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
CACHE_UNITS = 100_000
SEEN_UNITS = 400_000
SEEN_BITS = 22  # of a unit's hash, by which units that came before are known
CHUNK_UNITS = 100_000
BUILD_UNITS = 10_000  # lattices built at once
LIST_ROWS = 1_000  # rows that are Python objects at once
_LONG_UNIT = 48
# A word with the blanks before it; blanks, line ends and the mark itself where they stand alone.
_UNITS = re.compile(f" *[^ \n{SPACE_MARK}]+| +|\n|{SPACE_MARK}")


@dataclass(frozen=True)
class Sampling:
    """``power``: higher values favour frequent and so fewer pieces; ``offset``: evens out the first
    ranks; ``seed``: of all draws."""

    power: float = 1.5
    offset: float = 32.0
    seed: int = 1


@dataclass(frozen=True)
class Vocabulary:
    """``pieces``: (text, id, rank) without control and byte pieces; ``byte_ids``: id of each byte."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    size: int


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read on the driver and sent with the tasks, so workers need no file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    size = p.get_piece_size()
    pieces, byte_ids = [], [0] * 256
    for i in range(size):
        if p.is_byte(i):
            byte_ids[int(p.id_to_piece(i)[3:5], 16)] = i
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            pieces.append((p.id_to_piece(i), i, max(0.0, -p.get_score(i))))
    return Vocabulary(tuple(pieces), tuple(byte_ids), size)


class _Places(dict):
    """Numbers its keys as they come."""

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        return at


class Lattices(dict):
    """Unit to its packed lattice (characters, edges of each node, edges, cumulated shares)."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)
    # Every way to a node has the same characters, so a factor for each cancels out; this one keeps
    # the sums of units of up to _LONG_UNIT characters within double precision.
    _PER_CHARACTER = 1000.0

    def __init__(self, vocabulary: Vocabulary, how: Sampling) -> None:
        super().__init__()
        self.weights = {
            text: (i, (rank + how.offset) ** -how.power) for text, i, rank in vocabulary.pieces
        }
        self.longest = max((len(t) for t in self.weights), default=1)
        self.byte_ids = vocabulary.byte_ids
        self.fallback = (vocabulary.size + how.offset) ** -how.power
        # One byte for each hash instead of the units; where hashes clash, a unit is kept when it comes first.
        self.seen, self.n_seen = bytearray(1 << SEEN_BITS), 0
        self.tables = []
        self.filter = np.zeros(1 << 20, bool)  # of the upper bits of all pieces' hashes
        for n in range(1, self.longest + 1):
            texts = [t for t in self.weights if len(t) == n]
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), n)
            h = np.zeros(len(texts), np.uint64)
            for k in range(n):
                h = h * self._BASE + codes[:, k]
            self.filter[(h >> np.uint64(44)).astype(np.int64)] = True
            order = np.argsort(h)
            ids = np.array([self.weights[t][0] for t in texts], np.int32)
            weights = np.array([self.weights[t][1] for t in texts]) * self._PER_CHARACTER**n
            self.tables.append((h[order], ids[order], weights[order]))

    def load(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, edges of each node, edges and shares of ``units``, and where each of them is
        among these. Units that come a second time are kept; most come once."""
        if len(self) > CACHE_UNITS:
            self.clear()
        if self.n_seen > SEEN_UNITS:
            self.seen, self.n_seen = bytearray(1 << SEEN_BITS), 0
        packed, first, short, later = [], [], [], []
        for k, unit in enumerate(units):
            known = self.get(unit)
            if known is None and len(unit) > _LONG_UNIT:
                known = self.build(unit)
            if known is None:
                short.append(unit)
                later.append(k)
            else:
                packed.append(known)
                first.append(k)
        parts = [
            (
                np.array([p[0] for p in packed], np.int64),
                np.frombuffer(b"".join([p[1] for p in packed]), np.int32),
                np.frombuffer(b"".join([p[2] for p in packed]), np.int32).reshape(-1, 2),
                np.frombuffer(b"".join([p[3] for p in packed])),
            )
        ]
        for at in range(0, len(short), BUILD_UNITS):
            some = short[at : at + BUILD_UNITS]
            lengths, counts, edges, shares, bounds = self._build_all(some)
            parts.append((lengths, counts, edges, shares))
            starts = np.cumsum(lengths) - lengths
            for k, unit in enumerate(some):
                spot = hash(unit) & (1 << SEEN_BITS) - 1
                if self.seen[spot]:
                    a, b, c, n = bounds[k], bounds[k + 1], int(starts[k]), int(lengths[k])
                    self[unit] = (n, counts[c : c + n].tobytes(), edges[a:b].tobytes(), shares[a:b].tobytes())
                else:
                    self.seen[spot] = 1
                    self.n_seen += 1
        where = np.empty(len(units), np.int64)
        where[np.array(first + later, np.int64)] = np.arange(len(units))
        return (*(np.concatenate(c) for c in zip(*parts, strict=True)), where)

    def _build_all(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        text = "".join(units).replace(" ", SPACE_MARK)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        alone = [k for k, u in enumerate(units) if u == SPACE_MARK]
        codes[starts[alone]] = np.uint64(1 << 32)
        start, end = np.repeat(starts, lengths), np.repeat(ends, lengths)
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found = []
        for n, (keys, ids, weights) in enumerate(self.tables, 1):
            if n > 1:
                stays = at + n <= end[at]
                at, h = at[stays], h[stays]
            h = h * self._BASE + codes[at + n - 1]
            maybe = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
            few = h[maybe]
            spot = np.minimum(np.searchsorted(keys, few), max(0, len(keys) - 1))
            hit = keys[spot] == few if len(keys) else np.zeros(len(few), bool)
            spot, here = spot[hit], at[maybe[hit]]
            found.append((here, np.full(len(here), n), ids[spot], weights[spot]))
            if n == 1:
                bare = np.setdiff1d(at, here, assume_unique=True)
                code = codes[bare].astype(np.int64)
                code[code == 1 << 32] = ord(SPACE_MARK)
                byte = np.array(self.byte_ids, np.int64)[np.minimum(code, 127)]
                piece = np.where(code < 128, byte, -1 - code).astype(np.int32)
                weight = np.full(len(bare), self.fallback * self._PER_CHARACTER)
                found.append((bare, np.ones(len(bare), np.int64), piece, weight))
        begin, size, piece, weight = (np.concatenate(c) for c in zip(*found, strict=True))
        node = begin + size - 1
        order = np.argsort(node * 64 - size)
        begin, piece, weight, node = begin[order], piece[order], weight[order], node[order]
        per_node = np.bincount(node, minlength=len(codes))
        first = np.cumsum(per_node) - per_node
        # Level by level: the ways to all units' j-th characters follow from those to earlier ones.
        depth = (node - start[node]).astype(np.int16)
        by_depth = np.argsort(depth, kind="stable")
        level_ends = np.cumsum(np.bincount(depth))
        ways, share = np.zeros(len(codes) + 1), np.empty(len(node))
        ways[-1] = 1.0
        came = np.where(begin == start[node], len(codes), begin - 1)
        done = 0
        for level_end in level_ends.tolist():
            e = by_depth[done:level_end]
            done = level_end
            value = ways[came[e]] * weight[e]
            nodes = node[e]
            new = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
            total = np.add.reduceat(value, new)
            ways[nodes[new]] = total
            share[e] = value / np.repeat(total, np.diff(np.append(new, len(e))))
        share = np.cumsum(share) - node
        share[first + per_node - 1] = 1.0
        edges = np.stack([begin - start[node], piece], axis=1).astype(np.int32)
        bounds = np.append(first, len(node))[np.append(starts, len(codes))]
        return lengths, per_node.astype(np.int32), edges, share, bounds

    def build(self, unit: str) -> tuple[int, bytes, bytes, bytes]:
        """An edge is the node it comes from and its piece; a character that is no piece and has more
        than one byte is -1 - its code point."""
        alone = unit == SPACE_MARK
        u = unit.replace(" ", SPACE_MARK)
        n, get, longest = len(u), (lambda _: None) if alone else self.weights.get, self.longest
        ways = [1.0] + [0.0] * n
        counts, edges, shares = [], [], []
        for j in range(1, n + 1):
            found, total = [], 0.0
            for i in range(j - longest if j > longest else 0, j):
                hit = get(u[i:j])
                if hit is not None:
                    total += ways[i] * hit[1]
                    edges += (i, hit[0])
                    found.append(total)
            if get(u[j - 1]) is None:
                code = u[j - 1].encode()
                total += ways[j - 1] * self.fallback
                edges += (j - 1, self.byte_ids[code[0]] if len(code) == 1 else -1 - ord(u[j - 1]))
                found.append(total)
            counts.append(len(found))
            if total < 1e-200:
                # Shares are ratios, so the ways within reach may all be scaled.
                scale = 1 / total
                for i in range(max(0, j - longest), j):
                    ways[i] *= scale
                found = [x * scale for x in found]
                total = 1.0
            ways[j] = total
            shares += [x / total for x in found[:-1]]
            shares.append(1.0)
        return (
            n,
            np.array(counts, np.int32).tobytes(),
            np.array(edges, np.int32).tobytes(),
            np.array(shares, np.float64).tobytes(),
        )


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    def __init__(self, vocabulary: Vocabulary, how: Sampling = Sampling()) -> None:
        self.vocabulary, self.how = vocabulary, how
        self.lattices = Lattices(vocabulary, how)

    def chunks(
        self, keys: Iterable[int | None], texts: Iterable[str | None]
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pieces, number of pieces of each text) for runs of texts in order."""
        units: list[str] = []
        sizes: list[int] = []
        own: list[int | None] = []
        for key, text in zip(keys, texts, strict=True):
            found = _UNITS.findall(" " + (text or ""))
            units += found
            sizes.append(len(found))
            own.append(key)
            if len(units) >= CHUNK_UNITS:
                yield self._draw(own, units, np.array(sizes))
                units, sizes, own = [], [], []
        if own:
            yield self._draw(own, units, np.array(sizes))

    def _draw(self, keys: list[int | None], units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = _Places()
        which = np.fromiter(map(place.__getitem__, units), np.int64, len(units))
        lengths, per_node, edges, shares, where = self.lattices.load(list(place))
        which = where[which]
        # Node j of a unit has the number base + j - 1; its edges lie between it and the next.
        bounds = np.repeat(np.arange(len(per_node)), per_node) + shares
        last = np.cumsum(per_node) - 1
        base = (np.cumsum(lengths) - lengths)[which]
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        key = np.array([(k or 0) & (2**64 - 1) for k in keys], np.uint64)
        key = _scrambled(key + np.uint64(self.how.seed) * np.uint64(0x9E3779B97F4A7C15))
        inside = (np.arange(len(which)) - starts[row]).astype(np.uint64)
        noise = _scrambled(key[row] + inside * np.uint64(0xD1342543DE82EF95))
        node = lengths[which].copy()
        live = np.arange(len(which))
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(which), np.int64)
        while len(live):
            at = node[live]
            u = _scrambled(noise[live] + at.astype(np.uint64)) >> np.uint64(11)
            spot = base[live] + at - 1
            edge = np.searchsorted(bounds, spot + u * 2.0**-53, side="right")
            # Rounding may carry a draw to the next node's first edge.
            edge = np.minimum(edge, last[spot])
            drawn.append((live, edges[edge, 1]))
            count[live] += 1
            node[live] = edges[edge, 0]
            live = live[node[live] > 0]
        offset = np.cumsum(count) - count
        pieces = np.empty(int(count.sum()), np.int32)
        for step, (who, piece) in enumerate(drawn):
            pieces[offset[who] + count[who] - 1 - step] = piece
        of_row = np.bincount(row, weights=count, minlength=len(sizes)).astype(np.int64)
        if len(pieces) and pieces.min() < 0:
            pieces, of_row = self._with_bytes(pieces, of_row)
        return pieces, of_row

    def _with_bytes(self, pieces: np.ndarray, of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bad = np.flatnonzero(pieces < 0)
        codes = [chr(-1 - p).encode() for p in pieces[bad].tolist()]
        width = np.ones(len(pieces), np.int64)
        width[bad] = [len(c) for c in codes]
        out = np.repeat(pieces, width)
        first = np.cumsum(width) - width
        for at, code in zip(first[bad].tolist(), codes, strict=True):
            out[at : at + len(code)] = [self.vocabulary.byte_ids[b] for b in code]
        row = np.repeat(np.arange(len(of_row)), of_row)
        return out, np.bincount(row, weights=width, minlength=len(of_row)).astype(np.int64)


def _sampler(vocabulary: Vocabulary, how: Sampling) -> Sampler:
    """A worker's sampler, so that later tasks find the lattices of earlier ones."""
    return worker_state((vocabulary, how), lambda key: Sampler(*key))


def _values(column: pa.Array) -> Iterator:
    for start in range(0, len(column), LIST_ROWS):
        yield from column.slice(start, LIST_ROWS).to_pylist()


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        content = [b""] * vocabulary.size
        for text, i, _ in vocabulary.pieces:
            content[i] = text.replace(SPACE_MARK, " ").encode()
        for byte, i in enumerate(vocabulary.byte_ids):
            content[i] = bytes([byte])
        self.take = content.__getitem__

    def __call__(self, pieces: np.ndarray, sizes: list[int]) -> pa.Array:
        """Texts from the pieces of all rows; a size below 0 stands for a null."""
        texts, done = [], 0
        for size in sizes:
            if size < 0:
                texts.append(None)
                continue
            ids = pieces[done : done + size].tolist()
            texts.append(b"".join(map(self.take, ids)).decode()[1:])
            done += size
        return pa.array(texts, pa.string())


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    how: Sampling = Sampling(),
    keep: list[str] | None = None,
    decoded: bool = False,
) -> DataFrame:
    """doc_id, ``keep`` and ``ids`` (array of piece ids) for every row of ``docs`` (doc_id, text).
    ``decoded`` adds ``text``, decoded from the ids in the same task, for a check of the round trip.

    A blank is put before the text, as the vocabulary expects. Null texts count as empty, which is
    that blank; rows of one id draw alike, so repeated rows get equal ids; a null id draws as 0. An
    empty table gives an empty result. Columns outside ``keep`` are ignored.
    """
    ship_package(docs.sparkSession)
    kept = keep or []
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[F.col(f"`{c}`") for c in kept],
    )
    names = ["doc_id", *kept, "ids", *(["text"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, decoder = _sampler(vocabulary, how), Decoder(vocabulary)
        for batch in batches:
            done = 0
            for pieces, sizes in sampler.chunks(_values(batch.column(0)), _values(batch.column(1))):
                part = batch.slice(done, len(sizes))
                done += len(sizes)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                columns = [part.column(0), *[part.column(i + 2) for i in range(len(kept))]]
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(pieces)))
                if decoded:
                    columns.append(decoder(pieces, sizes.tolist()))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.drop("text").schema.add("ids", ArrayType(IntegerType()))
    return rows.mapInArrow(run, kind.add("text", StringType()) if decoded else kind)


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` with ``text`` in place of ``ids``; null ids give a null text."""
    ship_package(rows.sparkSession)
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            for start in range(0, len(batch), LIST_ROWS):
                part = batch.slice(start, LIST_ROWS)
                column = part.column(at)
                pieces = column.flatten().to_numpy(zero_copy_only=False)
                texts = decoder(pieces, column.value_lengths().fill_null(-1).to_pylist())
                yield part.set_column(at, "text", texts)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" if f.name != "ids" else "text string" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join(fields))
