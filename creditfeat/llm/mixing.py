"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives every document a posterior over domains. Document
rates r >= 0 are then fitted so that the expected tokens of every domain, sum(r * tokens * p), match
its target: projected gradient descent on the squared gap, in the geometry where a document counts
by its tokens and a gap by how hard the posteriors can move it, so the gradient of a document is its posterior times the scaled gap of the domains. A step
needs one pass over a narrow table and brings back two numbers per domain. Rates are stored once in
``hold`` steps; between, a document's rate follows from its posterior and the gaps since. The fit ends
where the targets are met or the projected gradient vanishes, which is as near as they can be met.

Rates start at 1 and are moved only as far as the gaps call for. ``copies`` turns a rate into whole
copies, whose expectation is the rate, by a draw from the document's id.
"""

from __future__ import annotations

import io
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditfeat.llm.attention import labelled_sample
from creditfeat.llm.common import pick, ship_package, stage
from creditfeat.llm.passages import Encoding, PassageEncoder, worker_encoder

#: Domains of the labels table with their shares of tokens.
TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}


# Least weight of a direction of the domains in the geometry of the fit, beside the strongest.
FLAT = 1e-4

#: The whole document is one passage.
WHOLE = Encoding(bins=1024, passage_words=1 << 40)


@dataclass(frozen=True)
class Mix:
    """``max_docs``: labelled documents that the classifier is fitted on, at most. ``anchor``: the
    domain whose tokens as they are set the total; None keeps the total of all tokens. The fit ends
    at ``gap``, the largest distance of a share from its target; at ``still``, the norm of the
    projected gradient beside the first one; or when ``patience`` steps in a row have not lowered
    the squared gap by the share ``least_gain``, so that it always ends. ``steps``: steps at most, None for no limit;
    ``hold``: steps until rates are stored; ``max_rate``: how often a document is used at most, None for no limit."""

    max_docs: int = 6000
    anchor: str | None = "good"
    gap: float = 1e-5
    still: float = 1e-7
    patience: int = 15
    least_gain: float = 0.02
    steps: int | None = None
    hold: int = 60
    max_rate: float | None = None
    epochs: int = 200
    rate: float = 0.05
    encoding: Encoding = WHOLE


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and ``domain`` (toxic before good or poor) of the labels table."""
    domain = (
        F.when(F.col("toxic") == 1, "toxic")
        .when(F.col("quality") == 1, "good")
        .when(F.col("quality") == 0, "poor")
    )
    return pick(labels, doc_id="bigint", quality="int", toxic="int").select(
        "doc_id", domain.alias("domain")
    )


def _traits(x: np.ndarray) -> np.ndarray:
    """Shares, and which of them aren't zero: a rare word of a long document has hardly a share."""
    return np.hstack([x, x > 0])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, domains: int, how: Mix) -> np.ndarray:
    """Weights of a softmax regression, the last row being the intercepts (Adam, whole batch)."""
    prior = np.log((np.bincount(y, minlength=domains) + 1) / (len(y) + domains))
    m = np.vstack([np.zeros((x.shape[1], domains)), prior]).astype(np.float32)
    if len(y) == 0:
        return m
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    mean, spread = np.zeros_like(m), np.zeros_like(m)
    for step in range(1, how.epochs + 1):
        gap = _softmax(x @ m)
        gap[np.arange(len(y)), y] -= 1
        grad = x.T @ gap / len(y) + 1e-5 * m
        mean, spread = 0.9 * mean + 0.1 * grad, 0.999 * spread + 0.001 * grad * grad
        m = m - how.rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return m


def fit_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], how: Mix) -> np.ndarray:
    """``labelled``: doc_id, domain; rows of other domains don't count."""
    ship_package(docs.sparkSession)
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    known = labelled.select("doc_id", place.cast("int").alias("place")).filter("place >= 0")
    sample = labelled_sample(docs, known, "place", how.max_docs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], na_position="first", kind="stable")
        chunks = PassageEncoder(how.encoding).chunks(pdf["text"].tolist())
        x = np.concatenate([_traits(f) for f, _, _ in chunks])
        np.save(out := io.BytesIO(), _fit(x, pdf["label"].to_numpy(np.int64), len(domains), how))
        return pd.DataFrame({"model": [out.getvalue()]})

    rows = sample.groupBy(F.lit(0).alias("one")).applyInPandas(run, "model binary").collect()
    if rows:
        return np.load(io.BytesIO(bytes(rows[0]["model"])))
    none = np.zeros((0, 2 * how.encoding.width))
    return _fit(none, np.zeros(0, np.int64), len(domains), how)


def posteriors(docs: DataFrame, model: np.ndarray, how: Mix) -> DataFrame:
    """doc_id, ``n_tokens`` (words of the whole text) and ``posteriors`` for every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(how.encoding)
        for batch in batches:
            shares, sizes = [], []
            for x, _, words in encoder.chunks(batch.column(1).to_pylist()):
                shares.append(_softmax(_traits(x) @ model[:-1] + model[-1]))
                sizes.append(words)
            if shares:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(shares).tolist(), pa.list_(pa.float64())),
                    ],
                    ["doc_id", "n_tokens", "posteriors"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, posteriors array<double>")


Step = tuple[list[float], bool]


def rates_of(
    p: np.ndarray, start: np.ndarray, path: list[Step], step: float, most: float | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rates after accelerated projected steps along ``path`` (a gap, and whether momentum
    starts anew), from ``start``, the rates at which the next gap is to be taken, and the last move."""
    rate = ahead = start
    move, pull = np.zeros(len(p)), 1.0
    for gap, anew in path:
        new = np.clip(ahead - step * (p @ np.asarray(gap)), 0.0, most)
        move = new - ahead
        further = 1.0 if anew else (1 + np.sqrt(1 + 4 * pull * pull)) / 2
        ahead = new if anew else new + (pull - 1) / further * (new - rate)
        rate, pull = new, further
    return rate, ahead, move


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _rated(members: DataFrame, path: list[Step], step: float, how: Mix) -> DataFrame:
    """``members`` with ``rate`` moved along ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                start = batch.column(3).to_numpy(zero_copy_only=False)
                rate, _, _ = rates_of(_matrix(batch.column(2)), start, path, step, how.max_rate)
                yield batch.set_column(3, "rate", pa.array(rate))

    kind = "doc_id bigint, n_tokens bigint, posteriors array<double>, rate double"
    return members.mapInArrow(run, kind)


def fit_rates(members: DataFrame, targets: list[float], how: Mix, anchor: int | None) -> DataFrame:
    """``members`` (doc_id, n_tokens, posteriors) with the fitted ``rate``. Warns of the gap that
    remains where the targets aren't met."""
    width = len(targets)
    p = [F.col("posteriors")[i] for i in range(width)]
    sums = [F.sum(F.col("n_tokens") * x) for x in p]
    products = [F.sum(F.col("n_tokens") * a * b) for a in p for b in p]
    row = members.agg(F.sum("n_tokens"), *sums, *products).first()
    members = members.select("doc_id", "n_tokens", "posteriors", F.lit(1.0).alias("rate"))
    total = float(row[0] or 0)
    if total == 0:
        return members
    have = np.array(row[1 : 1 + width], float) / total
    gram = np.array(row[1 + width :], float).reshape(width, width) / total
    want = np.asarray(targets, float) / sum(targets)
    if anchor is not None and want[anchor] > 0:
        want = want * have[anchor] / want[anchor]
    # Gaps are measured by the inverse of what rates can move (the Gram matrix of the posteriors), so
    # one step goes the whole way as long as no rate is held at a bound; a direction that hardly any
    # posterior has is weighed by at most 1 / FLAT of the strongest.
    strength, axes = np.linalg.eigh(gram)
    scale = axes / np.maximum(strength, FLAT * max(float(strength.max()), 1e-12)) @ axes.T
    step = 1.0
    path: list[Step] = []
    reached = ahead = have  # by the rates, and where the next gap is taken
    last = still = best = np.inf
    first, done, since = 0.0, 0, 0
    while True:
        gap = reached - want
        now = float(gap @ scale @ gap)
        if now < (1 - how.least_gain) * best:
            best, since = now, 0
        else:
            since += 1
        stuck = still <= how.still * max(1.0, first) or since >= how.patience
        if np.abs(gap).max() <= how.gap:
            break
        if stuck or done == how.steps:
            why = "can't be met" if stuck else f"aren't met after {done} steps"
            warnings.warn(f"targets {why}; gaps by domain: {gap.tolist()}", stacklevel=2)
            break
        if len(path) == how.hold:
            members = stage(_rated(members, path, step, how), "rates")
            path, ahead = [], reached
        path.append((((ahead - want) @ scale).tolist(), now > last))
        last = now
        done += 1

        def run(batches: Iterator[pa.RecordBatch], path=tuple(path)) -> Iterator[pa.RecordBatch]:
            at = np.zeros(2 * width + 1)
            for batch in batches:
                q = _matrix(batch.column(1))
                if len(q):
                    tokens, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
                    rate, further, move = rates_of(q, start, path, step, how.max_rate)
                    at[:width] += (rate * tokens) @ q
                    at[width:-1] += (further * tokens) @ q
                    at[-1] += (move * move) @ tokens
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in at], [f"s{i}" for i in range(len(at))])

        kind = ", ".join(f"s{i} double" for i in range(2 * width + 1))
        parts = members.select("n_tokens", "posteriors", "rate").mapInArrow(run, kind)
        found = np.array(parts.agg(*[F.sum(c) for c in parts.columns]).first(), float) / total
        reached, ahead, still = found[:width], found[width:-1], float(np.sqrt(found[-1])) / step
        first = still if done == 1 else first
    return _rated(members, path, step, how)


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, how: Mix = Mix()
) -> DataFrame:
    """doc_id, n_tokens, posteriors, ``rate`` and ``copies`` for every row of ``docs``.

    Null and empty texts have no tokens: they get a rate by their posterior but don't bear on the
    fit. Repeated rows count as often as they occur and get equal copies. Without labels all
    posteriors are even. Targets that no rates meet, such as of a domain nobody belongs to, are met as
    nearly as least squares gets, with a warning. An empty table gives an empty result; further columns are ignored.
    """
    domains = sorted(targets)
    docs = pick(docs, doc_id="bigint", text="string")
    model = fit_posteriors(docs, labelled, domains, how)
    members = stage(posteriors(docs, model, how), "posteriors")
    anchor = domains.index(how.anchor) if how.anchor is not None else None
    rated = fit_rates(members, [targets[d] for d in domains], how, anchor)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 52)) / float(1 << 52)
    whole = F.floor("rate")
    copies = whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)
    return rated.withColumn("copies", copies.cast("bigint"))
