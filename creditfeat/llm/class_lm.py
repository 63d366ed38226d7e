"""LM scoring with a Brown class-based bigram model.

Exchange clustering assigns words to classes so that class bigrams are as likely as can be; the
probability of a token mixes class transition times word emission with the smoothed unigram:

    p(w | v) = weight * p(class(w) | class(v)) * e(w) + (1 - weight) * p0(w)
    e(w)     = (c(w) + 0.5) / (N(class) + 0.5 * (V(class) + 1))
    p0(w)    = (c(w) + 0.5) / (N + 0.5 * (V + 1))

N are tokens and V distinct words, of a class or of all; the 1 stands for words unknown in training,
which count as the class of their unit. As e and p0 smooth alike, their ratio is one number for each
class, so the weight is fitted by expectation maximisation on class bigrams alone: the model is
learned from most training rows, the weight from the others (drawn by hash), then transitions are
counted over all of them.

Exchange begins with units: the most frequent words, and groups of all other words by their ending.
One task clusters the table of unit bigrams, which is bounded by the number of units. Then every other
word leaves its group: the classes before and after its occurrences are brought together, and it moves,
by the same criterion and for itself, to the class that raises the likelihood most. All words move at once
in one such round, against the classes of the units, as in distributed exchange clustering. Words that
don't occur in training stay with their unit.

Word counts aren't bounded, so they are never gathered: documents are dealt into blocks of bounded text,
what a block knows of a word goes to the word and its count and class come back to the block. A block's
texts become classes, from which transitions are counted and scores are made.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditfeat.llm.common import fold_of, pick, ship_package, stage

END = ""  # no word is empty


@dataclass(frozen=True)
class Brown:
    """``top_words``: words that are units; ``endings``: units of other words;
    ``classes``: 127 at most; ``sweeps``: passes of exchange over the units at most; ``apart``: one of so many
    training rows, drawn by hash, is kept from the exchange and fits the weight of the class model;
    ``smooth``: added to class transitions; ``block_bytes``: text of a block."""

    top_words: int = 1500
    endings: int = 64
    classes: int = 48
    sweeps: int = 6
    apart: int = 8
    smooth: float = 0.5
    block_bytes: int = 24 << 20


class _Units(dict):
    """Word to unit: 0 is the end of a text, then the top words, then the endings."""

    def __init__(self, top: list[str], endings: int) -> None:
        super().__init__({w.encode(): i + 1 for i, w in enumerate(top)})
        self.first, self.endings = len(top) + 1, endings
        self.size = self.first + endings

    def __missing__(self, word: bytes) -> int:
        return self.first + zlib.crc32(word[-2:]) % self.endings


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of every unit from the dense unit bigrams. Unit 0 keeps class 0 for itself; the others
    start dealt round by frequency and are moved, one at a time, to the class that raises the
    likelihood of the class bigrams most, until a sweep moves none."""
    units = len(counts)
    order = 1 + np.argsort(-counts.sum(axis=0)[1:], kind="stable")
    of = np.zeros(units, np.int64)
    of[order] = 1 + np.arange(units - 1) % max(1, classes - 1)
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    to, fro = counts @ member, counts.T @ member  # from and to each unit, by class
    table = member.T @ to
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, own = of[u], counts[u, u]
            r, c = to[u].copy(), fro[u].copy()
            r[a] -= own
            c[a] -= own
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            # Bigrams between u and other classes count for those classes wherever u goes.
            rows, columns = table.sum(axis=1) + c, table.sum(axis=0) + r
            base = _gain(table)
            across = _gain(table + r) - base
            down = _gain(table + c[:, None]) - base
            diagonal = np.diag(table)
            gain = across.sum(axis=1) - np.diag(across) + down.sum(axis=0) - np.diag(down)
            gain += _gain(diagonal + r + c + own) - _gain(diagonal)
            gain -= _gain(rows + r.sum() + own) - _gain(rows)
            gain -= _gain(columns + c.sum() + own) - _gain(columns)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b] += r
            table[:, b] += c
            table[b, b] += own
            if b != a:
                moved += 1
                of[u] = b
                to[:, a] -= counts[:, u]
                to[:, b] += counts[:, u]
                fro[:, a] -= counts[u]
                fro[:, b] += counts[u]
        if not moved:
            break
    return of


def best_classes(table: np.ndarray, of: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class that each word moves to, as in ``exchange``, when all others stay. ``table``: class bigrams,
    with the words in their classes ``of``; ``before`` and ``after``: bigrams of the words (rows) with other
    words by class; ``own``: of a word with itself."""
    at, gain = np.arange(len(of)), np.zeros(after.shape)
    for cells, here, there in ((table.T, after, before), (table, before, after)):
        word, other = np.nonzero(here)
        if not len(word):
            continue
        n, place = here[word, other].astype(float), np.arange(len(word))
        # What bigrams of each class with the ``other`` one are without the word.
        cell = cells[other].astype(float)
        cell[place, of[word]] -= n
        same = np.flatnonzero(other == of[word])
        cell[same] -= there[word[same]]
        np.maximum(cell, 0, out=cell)
        more = _gain(cell + n[:, None]) - _gain(cell)
        more[place, other] = 0  # the diagonal, below
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        gain[word[starts]] += np.add.reduceat(more, starts)
    inner = (before + after + own[:, None]).astype(float)
    word, to = np.nonzero(inner)
    n, held = inner[word, to], np.diag(table)[to].astype(float)
    held -= np.where(to == of[word], n, 0)
    gain[word, to] += _gain(held + n) - _gain(held)
    for totals, side in ((table.sum(axis=1), after), (table.sum(axis=0), before)):
        sizes, which = np.unique(side.sum(axis=1) + own, return_inverse=True)
        less = _gain(totals + sizes[:, None].astype(float)) - _gain(totals.astype(float))
        less = less[which]
        less[at, of] = _gain(totals[of].astype(float)) - _gain(totals[of] - sizes[which].astype(float))
        gain -= less
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[at, best] > gain[at, of] + 1e-9, best, of)


def _words(text: bytes | None) -> list[bytes]:
    # bytes: lower() changes A-Z only, split() cuts at the white space of the contract only
    return (text or b"").lower().split()


def blocked(docs: DataFrame, how: Brown) -> DataFrame:
    """(block, doc_id, text, train, apart): runs of rows of one task with at most ``block_bytes`` of text or
    one row, staged. ``apart``: a training row that the weight is fitted on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = batch.column(1).cast(pa.binary()).to_pylist()
            blocks = []
            for text in sizes:
                if held and held + len(text or b"") > how.block_bytes:
                    block, held = block + 1, 0
                held += len(text or b"")
                blocks.append(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), *batch.columns], ["block", *batch.schema.names]
            )

    rows = pick(docs, doc_id="bigint", text="string").withColumn("train", fold_of(F.col("doc_id")) != 1)
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(how.apart)) == 0
    rows = rows.withColumn("apart", F.col("train") & apart)
    kind = "block bigint, doc_id bigint, text string, train boolean, apart boolean"
    return stage(rows.mapInArrow(run, kind), "blocks")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of training rows, without the end."""

    def emit(counts: Counter) -> Iterator[pa.RecordBatch]:
        words, n = list(counts), list(counts.values())
        for at in range(0, len(words), 200_000):
            part = pa.array(words[at : at + 200_000], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part, pa.array(n[at : at + 200_000], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(_words(text))
            if len(counts) > 500_000:
                yield from emit(counts)
                counts = Counter()
        yield from emit(counts)

    counted = docs.filter("train").select("text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class _Vocabulary(dict):
    """Word to number, in the order of first sight; 0 is the end."""

    def __init__(self) -> None:
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _bytes_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes cut into cells of the given sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def block_words(docs: DataFrame, top: list[str], of: np.ndarray, how: Brown) -> DataFrame:
    """(block, word, n, beside) of every word of a block and of the end. ``n`` counts training rows only;
    ``beside``: of words that are no units, a byte for each word beside them in rows that classes are
    learned from: its class if it comes before, with ``classes`` added if it comes after, twice
    ``classes`` if it is the word itself."""
    width = 2 * how.classes + 1

    def emit(block: int, units: _Units, words: _Vocabulary, train: list, learned: list) -> Iterator[pa.RecordBatch]:
        unit = np.array([0, *(units[w] for w in list(words)[1:])], np.int64)
        group, tail = of[unit], unit >= units.first
        none = np.zeros(0, np.int64)
        n = np.bincount(np.concatenate([none, *(ids[1:] for ids in train)]), minlength=len(words))
        one = np.concatenate([none, *(ids[:-1] for ids in learned)])
        two = np.concatenate([none, *(ids[1:] for ids in learned)])
        twice = one == two
        a, b = tail[one] & ~twice, tail[two] & ~twice
        found = [one[a] * width + how.classes + group[two[a]], two[b] * width + group[one[b]]]
        found.append(one[tail[one] & twice] * width + 2 * how.classes)
        del one, two, twice, a, b
        found = np.concatenate(found)
        found.sort()
        sizes = np.bincount(found // width, minlength=len(words))
        found %= width
        beside = _bytes_array(found.astype(np.uint8), sizes)
        del found
        names = pa.array(list(words), pa.binary()).cast(pa.string())
        for at in range(0, len(names), 200_000):
            part = slice(at, min(at + 200_000, len(names)))
            columns = [pa.array(np.full(part.stop - at, block)), names[part], pa.array(n[part]), beside[part]]
            yield pa.RecordBatch.from_arrays(columns, ["block", "word", "n", "beside"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _Units(top, how.endings)
        now, words, train, learned = None, _Vocabulary(), [], []
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rest = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for text, block, is_train, apart in zip(texts, *rest, strict=True):
                if block != now:
                    if now is not None:
                        yield from emit(now, units, words, train, learned)
                    now, words, train, learned = block, _Vocabulary(), [], []
                found = _words(text)
                ids = np.zeros(len(found) + 2, np.int32)
                ids[1:-1] = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                if is_train:
                    train.append(ids)
                    if not apart:
                        learned.append(ids)
        if now is not None:
            yield from emit(now, units, words, train, learned)

    kind = "block bigint, word string, n bigint, beside binary"
    return docs.select("block", "text", "train", "apart").mapInArrow(run, kind)


def placed_words(words: DataFrame, top: list[str], of: np.ndarray, table: np.ndarray, how: Brown) -> DataFrame:
    """``words`` of ``block_words`` with their count in all blocks and their class, packed by block: (block,
    words, totals, classes, types, tokens). ``types``, ``tokens``: distinct words of training by class and their
    tokens, each word in one row only. ``table``: class bigrams that the units' classes ``of`` give."""
    width = 2 * how.classes + 1

    def pack(rows: pa.RecordBatch, units: _Units) -> pa.RecordBatch:
        word = rows.column("word").cast(pa.binary())
        fresh = np.ones(len(rows), bool)
        fresh[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
        starts, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        names = word.take(pa.array(starts)).to_pylist()
        total = np.add.reduceat(rows.column("n").to_numpy(), starts)
        group = of[np.array([units[w] if w else 0 for w in names], np.int64)]
        beside = rows.column("beside")
        owner = np.repeat(run, pc.binary_length(beside).to_numpy())
        cell = np.frombuffer(b"".join(beside.to_pylist()), np.uint8)
        bounds = np.searchsorted(owner, np.arange(len(names) + 1))  # rows are sorted by word
        moving = np.flatnonzero(np.diff(bounds))
        for at in range(0, len(moving), 2048):
            some = moving[at : at + 2048]
            part = slice(bounds[some[0]], bounds[some[-1] + 1])
            code = np.searchsorted(some, owner[part]) * width + cell[part]
            counts = np.bincount(code, minlength=len(some) * width).reshape(-1, width)
            before, after = counts[:, : how.classes], counts[:, how.classes : -1]
            group[some] = best_classes(table, group[some], before, after, counts[:, -1])
        block = rows.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        made = []
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            mine = run[part]
            texts = b"\n".join([names[i] for i in mine.tolist()])  # no word has a line feed
            made.append((block[part[0]], texts, total[mine].tobytes(), group[mine].astype(np.uint8).tobytes(), None, 0))
        types = np.bincount(group[total > 0], minlength=how.classes).tolist()
        made[0] = (*made[0][:4], types, int(total.sum()))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["block", "words", "totals", "classes", "types", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _Units(top, how.endings)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < 300_000:
                continue
            rows = pa.concat_batches(held)
            word = rows.column("word")
            # The rows of the last word may not have ended: it has a row for each block.
            last = len(rows) - int(pc.sum(pc.equal(word, word[-1])).as_py())
            if last:
                yield pack(rows.slice(0, last), units)
            held = [rows.slice(last)]
        if held and sum(map(len, held)):
            yield pack(pa.concat_batches(held), units)

    kind = "block bigint, words binary, totals binary, classes binary, types array<bigint>, tokens bigint"
    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, kind)


def unit_bigrams(docs: DataFrame, top: list[str], how: Brown) -> DataFrame:
    """(pair, n): summed counts of unit bigrams in the rows that classes are learned from, pair = first *
    units + second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _Units(top, how.endings)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            both, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(both), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words = _words(text)
                ids = np.zeros(len(words) + 2, np.int64)
                ids[1:-1] = np.fromiter(map(units.__getitem__, words), np.int64, len(words))
                held.append(ids[:-1] * units.size + ids[1:])
                size += len(ids)
                if size >= 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = docs.filter("train and not apart").select("text").mapInArrow(run, "pair bigint, n bigint")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def _transitions(table: np.ndarray, smooth: float) -> np.ndarray:
    # A class without tokens is never reached.
    shares = (table + smooth) * (table.sum(axis=0) > 0)
    return shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)


def fit_weight(counts: np.ndarray, ratio: np.ndarray, rounds: int = 200) -> float:
    """The weight of the class model by expectation maximisation. ``counts``: class bigrams of rows the
    model wasn't learned from; ``ratio``: probability by class over that of the unigram."""
    total, weight = counts.sum(), 0.5
    if total == 0:
        return 0.0
    for _ in range(rounds):
        part = weight * ratio / np.maximum(weight * ratio + 1 - weight, 1e-300)
        weight = float((counts * part).sum() / total)
    return min(weight, 0.999)


def fit_classes(bigrams: DataFrame, units: int, how: Brown) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the bigrams of these classes. One task clusters the table, which has at
    most units ** 2 rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(units * units)
        counts[pdf["pair"].to_numpy()] = pdf["n"].to_numpy()
        counts = counts.reshape(units, units)
        of = exchange(counts, how.classes, how.sweeps)
        member = np.zeros((units, how.classes))
        member[np.arange(units), of] = 1
        np.savez(out := io.BytesIO(), of=of, table=member.T @ counts @ member)
        return pd.DataFrame({"model": [out.getvalue()]})

    rows = bigrams.groupBy(F.lit(0).alias("one")).applyInPandas(run, "model binary").collect()
    if not rows:
        return np.zeros(units, np.int64), np.zeros((how.classes, how.classes))
    with np.load(io.BytesIO(bytes(rows[0]["model"]))) as model:
        return model["of"], model["table"]


def fit_ratio(every: np.ndarray, apart: np.ndarray, types: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """Of a class bigram, transition times what emission has over the unigram; and the weight of the
    class model. ``every``, ``apart``: class bigrams; ``types``: distinct words of each class."""

    def ratio(table: np.ndarray) -> np.ndarray:
        tokens = table.sum(axis=0)
        unigram = tokens.sum() + 0.5 * (types.sum() + 1)
        return _transitions(table, smooth) * unigram / (tokens + 0.5 * (types + 1))

    return ratio(every), fit_weight(apart, ratio(every - apart))


def class_bigrams(tagged: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams of training rows, and of those apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, classes * classes), np.int64)
        for batch in batches:
            for tags, apart in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = np.frombuffer(b"\0" + tags, np.uint8).astype(np.int64)
                counts[int(apart)] += np.bincount(of[:-1] * classes + of[1:], minlength=classes * classes)
        kind, pair = np.nonzero(counts)
        columns = [pa.array(pair), pa.array(kind == 1), pa.array(counts[kind, pair])]
        yield pa.RecordBatch.from_arrays(columns, ["pair", "apart", "n"])

    rows = tagged.filter("train").select("tags", "apart").mapInArrow(run, "pair bigint, apart boolean, n bigint")
    found = np.zeros((2, classes * classes))
    for row in rows.groupBy("pair", "apart").agg(F.sum("n").alias("n")).collect():  # pairs of classes
        found[int(row["apart"]), row["pair"]] = row["n"]
    rest, apart = found.reshape(2, classes, classes)
    return rest + apart, apart


def class_scores(docs: DataFrame, how: Brown = Brown()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of
    ``docs`` (doc_id, text), learned from rows whose crc32(doc_id) mod 5 is not 1.

    A null text is empty and has the end as its only token. A null id falls in the fold of the empty
    text. Repeated rows count as often as they occur. Without training rows every probability is that
    of an unknown word. Further columns are ignored; an empty table gives an empty result.
    """
    if not 1 <= how.classes <= 127:
        raise ValueError("classes are numbered in bytes: 1 to 127")
    ship_package(docs.sparkSession)
    docs = blocked(docs, how)
    leading = word_counts(docs).orderBy(F.desc("n"), "word").limit(how.top_words)
    top = [r["word"] for r in leading.collect()]
    of, table = fit_classes(unit_bigrams(docs, top, how), len(top) + 1 + how.endings, how)
    words = stage(placed_words(block_words(docs, top, of, how), top, of, table, how), "words")
    n_tokens = words.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    types = np.zeros(how.classes)
    by_class = words.select(F.posexplode("types").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n"))
    for row in by_class.collect():  # a row for each class
        types[row["class"]] = row["n"]
    unseen = n_tokens + 0.5 * (types.sum() + 1)

    def tag(texts: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        names = [w for part in packed["words"] for w in part.split(b"\n")]
        place = {w: i for i, w in enumerate(names)}
        n = np.frombuffer(b"".join(packed["totals"]), np.int64).astype(np.float64)
        group = np.frombuffer(b"".join(packed["classes"]), np.uint8)
        log_base = np.log10((n + 0.5) / unseen)
        rows = []
        for doc_id, text, train, apart in zip(*(texts[c] for c in ("doc_id", "text", "train", "apart")), strict=True):
            tokens = _words(text.encode() if isinstance(text, str) else None)
            ids = np.empty(len(tokens) + 1, np.int64)
            ids[:-1] = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
            ids[-1] = place[b""]
            known, base = int((n[ids] > 0).sum()), float(log_base[ids].sum())
            rows.append((doc_id, train, apart, len(ids), known, base, group[ids].tobytes()))
        columns = ["doc_id", "train", "apart", "n_tokens", "n_known", "base_score", "tags"]
        return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    kind = "doc_id bigint, train boolean, apart boolean, n_tokens bigint, n_known bigint, base_score double, tags binary"
    both = docs.groupBy("block").cogroup(words.select("block", "words", "totals", "classes").groupBy("block"))
    tagged = stage(both.applyInPandas(tag, kind), "tagged")
    ratio, weight = fit_ratio(*class_bigrams(tagged, how.classes), types, how.smooth)
    over = np.log10(weight * ratio + 1 - weight).ravel()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for tags in batch.column("tags").to_pylist():
                classes = np.frombuffer(b"\0" + tags, np.uint8).astype(np.int64)
                more.append(over[classes[:-1] * how.classes + classes[1:]].sum())
            scores = pc.add(batch.column("base_score"), pa.array(more, pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*batch.schema.names[:-1], "score"])

    kept = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    scored = tagged.withColumn("held_out", ~F.col("train")).select(*kept, "tags")
    kind = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    return scored.mapInArrow(score, kind).withColumn("train_tokens", F.lit(int(n_tokens)).cast("bigint"))
