"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are equal) of at least ``times`` * q
and ``least`` words that no neighbouring word extends. All runs of a text are found:

1. At scale t = 8, 16, 32, ... every window of t words has a hash. A position i is synchronising if the
   least hash of the windows at i, ..., i + t is that at i or at i + t. This depends on the 2 t words
   from i on only, so what repeats has its synchronising positions at the same places.
2. Windows with a period of t / 4 or less have no hash; else highly periodic text would consist of
   synchronising positions. Any t successive positions hold a synchronising one then, unless all
   3 t - 1 words from the first on have such a small period.
3. A run with a period q from t to 2 t - 1 has, in its first t words, a synchronising position whose 2 t
   words occur again q words later and not in between. So the successive positions of equal context
   that are t to 2 t - 1 apart propose all such periods. Proposals are extended word by word, which
   also confirms them: a collision of hashes is no run.
4. The regions without hashes at a scale are runs of smaller periods, known from the scales before;
   periods below 8 are detected by comparing the words of every small distance directly.

Texts are worked on in tasks, several at once; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditfeat.llm.common import SPACE, pick, ship_package

SMALL = 8  # periods below are compared directly; the first scale
CHUNK_WORDS = 200_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Periods:
    """``times``: least length of a run in periods, 4 at least; ``least``: in words."""

    times: int = 4
    least: int = 6

    def __post_init__(self) -> None:
        if self.times < 4:
            raise ValueError("synchronising sets find runs of four periods or more")

    def length(self, period: int) -> int:
        return max(self.least, self.times * period)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _stretches(x: np.ndarray, period: int, least: int) -> np.ndarray:
    """(start, end) of every maximal stretch of at least ``least`` words with that period."""
    if len(x) <= period:
        return np.zeros((0, 2), np.int64)
    breaks = np.flatnonzero(x[:-period] != x[period:])
    breaks = np.concatenate([[-1], breaks, [len(x) - period]])
    long = np.flatnonzero(np.diff(breaks) - 1 + period >= least)
    return np.stack([breaks[long] + 1, breaks[long + 1] + period], axis=1)


def _extended(x: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The maximal stretch with that period around ``at``; shorter than the period if there's none."""
    end, step = at, 64
    while end < len(x) - period:
        n = min(step, len(x) - period - end)
        differ = np.flatnonzero(x[end : end + n] != x[end + period : end + period + n])
        if len(differ):
            end += int(differ[0])
            break
        end, step = end + n, 2 * step
    start, step = at, 64
    while start > 0:
        n = min(step, start)
        differ = np.flatnonzero(x[start - n : start] != x[start - n + period : start + period])
        if len(differ):
            start -= n - 1 - int(differ[-1])
            break
        start, step = start - n, 2 * step
    return start, end + period


def proposals(x: np.ndarray, scale: int, regular: np.ndarray) -> np.ndarray:
    """(position, period) pairs that synchronising positions of equal context propose. ``regular``:
    (start, end) of the regions whose period is ``scale`` / 4 or less."""
    n = len(x)
    if n < 2 * scale + 1:
        return np.zeros((0, 2), np.int64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(x.astype(np.uint64)) * _powers(_BASE, n), out=prefix[1:])
    back = _powers(_BACK, n)

    def window(at: np.ndarray | slice, width: int) -> np.ndarray:
        return _mixed((prefix[width:][at] - prefix[: n + 1 - width][at]) * back[: n + 1 - width][at])

    most = np.uint64(2**64 - 1)
    hashes = np.minimum(window(slice(None), scale), most - np.uint64(1))
    for start, end in regular:
        hashes[start : max(start, end - scale + 1)] = most
    least = _least(hashes, scale + 1)
    count = len(least)
    here = (least == hashes[:count]) | (least == hashes[scale : scale + count])
    sync = np.flatnonzero(here & (least != most))
    context = window(sync, 2 * scale)
    order = np.lexsort((sync, context))
    context, sync = context[order], sync[order]
    apart = np.diff(sync)
    found = np.flatnonzero((context[1:] == context[:-1]) & (apart >= scale) & (apart < 2 * scale))
    return np.stack([sync[found], apart[found]], axis=1)


def find_runs(texts: list[np.ndarray], how: Periods = Periods()) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of every text, by start, then period. A text is an array
    of word numbers from 0 on."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    found: dict[tuple[int, int], int] = {}  # stretch of the joined texts -> smallest period
    # An own number after each text, equal to nothing, keeps runs and contexts inside it.
    marked = [np.append(t, base + i) for i, t in enumerate(texts)]
    first = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.concatenate(marked) if marked else np.zeros(0, np.int64)

    def note(start: int, end: int, period: int) -> None:
        known = found.get((start, end))
        if known is None or period < known:
            found[start, end] = period

    for period in range(1, SMALL):
        for start, end in _stretches(joined, period, how.length(period)).tolist():
            note(start, end, period)
    scale = SMALL
    while len(chosen := np.flatnonzero(sizes >= how.length(scale))):
        x = np.concatenate([marked[i] for i in chosen])
        here = np.cumsum(sizes[chosen] + 1) - (sizes[chosen] + 1)
        shift = dict(zip(chosen.tolist(), (here - first[chosen]).tolist(), strict=True))
        regular = []
        for (start, end), period in found.items():
            text = int(np.searchsorted(first, start, "right")) - 1
            if 4 * period <= scale <= end - start and text in shift:
                regular.append((start + shift[text], end + shift[text]))
        pairs = proposals(x, scale, np.array(regular, np.int64).reshape(-1, 2))
        back = first[chosen] - here
        done = (0, -1, -1)
        for at, period in pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))].tolist():
            if done[0] == period and done[1] <= at < done[2] - period:
                continue
            start, end = _extended(x, at, period)
            done = (period, start, end)
            if end - start >= how.length(period):
                move = int(back[np.searchsorted(here, start, "right") - 1])
                note(start + move, end + move, period)
        scale *= 2
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, end), period in found.items():
        text = int(np.searchsorted(first, start, "right")) - 1
        runs[text].append((start - int(first[text]), end - start, period))
    for of_text in runs:
        of_text.sort(key=lambda r: (r[0], r[2]))
    return runs


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def _chunks(texts: Iterable[pa.Scalar]) -> Iterator[list[list[bytes]]]:
    chunk, held = [], 0
    for text in texts:
        chunk.append((text.as_py() or b"").split())
        held += len(chunk[-1])
        if held >= CHUNK_WORDS:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def periodic_runs(docs: DataFrame, how: Periods = Periods()) -> DataFrame:
    """doc_id, ``runs`` (start, length, period; by start, then period) and ``collapsed`` for every row of
    ``docs`` (doc_id, text).

    Words are cut at the white space of ASCII and numbered from 0. ``collapsed`` is the text's words
    but those that any run contains after its first period, joined by one blank. Null, empty and
    blank texts have no words and no runs. Rows stay as they are, with null and repeated ids and
    repeated texts; an empty table gives an empty result; further columns are ignored.
    """
    ship_package(docs.sparkSession)
    struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for chunk in _chunks(batch.column(1).cast(pa.binary())):
                numbers = _Numbers()
                ids = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in chunk]
                runs = find_runs(ids, how)
                flat = np.array([r for of_text in runs for r in of_text], np.int64).reshape(-1, 3)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(struct))
                texts = [_collapsed(words, r) for words, r in zip(chunk, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(chunk)),
                        pa.ListArray.from_arrays(pa.array(offsets), values),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "runs", "collapsed"],
                )
                done += len(chunk)

    rows = pick(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(run, f"doc_id bigint, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first."""
    return F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where the words of one document in ten, chosen by crc32 of its id, repeat from
    some word on with some period, both taken from that hash. A null id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = pick(docs, doc_id="bigint", text="string").withColumn("_g", F.floor(h / 10)).withColumn("_chosen", h % 10 == 0)
    rows = rows.withColumn("_words", F.when(F.col("_chosen"), F.array_remove(F.split("text", SPACE + "+"), "")))
    rows = rows.withColumn("_n", F.size("_words").cast("bigint"))
    a = F.col("_g") % F.col("_n")
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, a).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = (F.col("_n") - F.col("_a")).cast("int")
    block = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    often = F.ceil(rest / F.col("_p")).cast("int")
    words = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(F.flatten(F.array_repeat(block, often)), F.lit(1), rest))
    new = F.when(F.col("_chosen") & (F.col("_n") > 0), F.array_join(words, " ")).otherwise(F.col("text"))
    return rows.select("doc_id", new.alias("text"))
