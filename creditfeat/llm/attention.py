"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage x is encoded as h = relu(W x + b); gated attention
a = softmax(w . (tanh(V h) * sigmoid(U h))) over the document's passages weights them, and the
document's score is sigmoid(c . sum(a h) + d). Only document labels are needed to learn all of it.

The fit uses a bounded sample of labelled documents, the ``max_docs`` of them that come first by
hash of their id, so it fits one task whatever the size of the tables. Every document is scored on
its whole text by a map over the table.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from creditfeat.llm.common import fold_of, pick, ship_package
from creditfeat.llm.passages import Encoding, PassageEncoder, worker_encoder

# Rows with all their columns that a worker scores and hands back at once.
PART_ROWS = 1000


@dataclass(frozen=True)
class Fit:
    """``max_docs``: labelled documents that the model is fitted on, at most. ``steps``: batches of
    ``batch_docs`` documents that the fit takes, whatever their number."""

    max_docs: int = 6000
    hidden: int = 32
    gates: int = 16
    steps: int = 1200
    batch_docs: int = 128
    rate: float = 0.004
    decay: float = 1e-4
    seed: int = 7
    encoding: Encoding = field(default_factory=Encoding)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(m: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """``sizes``: passages of each document, all at least 1."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    h = np.maximum(x @ m["W"] + m["b"], 0)
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
    a = e / np.add.reduceat(e, starts)[doc]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    y = _sigmoid(z @ m["c"] + m["d"])
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "doc": doc, "starts": starts}


def _gradients(
    m: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, labels: np.ndarray
) -> dict[str, np.ndarray]:
    f = _forward(m, x, sizes)
    h, t, g, a, doc = f["h"], f["t"], f["g"], f["a"], f["doc"]
    dy = (f["y"] - labels) / len(labels)
    dz = dy[:, None] * m["c"]
    dh = a[:, None] * dz[doc]
    da = np.einsum("ij,ij->i", h, dz[doc])
    de = a * (da - np.add.reduceat(a * da, f["starts"])[doc])
    dtg = de[:, None] * m["w"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh += dt @ m["V"].T + dg @ m["U"].T
    dh *= h > 0
    return {
        "W": x.T @ dh,
        "b": dh.sum(0),
        "V": h.T @ dt,
        "U": h.T @ dg,
        "w": (t * g).T @ de,
        "c": f["z"].T @ dy,
        "d": dy.sum(keepdims=True),
    }


def fit_bags(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, how: Fit) -> dict[str, np.ndarray]:
    """Adam over batches of documents. Without both labels, a model that gives the smoothed share
    of label 1 to every document."""
    rng = np.random.default_rng(how.seed)
    width = how.encoding.width

    def start(a: int, b: int) -> np.ndarray:
        return (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

    share = (labels.sum() + 1) / (len(labels) + 2)
    m = {
        "W": 4 * start(width, how.hidden),
        "b": np.zeros(how.hidden, np.float32),
        "V": start(how.hidden, how.gates),
        "U": start(how.hidden, how.gates),
        "w": np.zeros(how.gates, np.float32),
        "c": np.zeros(how.hidden, np.float32),
        "d": np.array([np.log(share / (1 - share))], np.float32),
    }
    if len(np.unique(labels)) < 2:
        return m
    m["c"] = (0.1 * rng.standard_normal(how.hidden)).astype(np.float32)
    m["w"] = (0.1 * rng.standard_normal(how.gates)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(sizes)])
    mean = {k: np.zeros_like(v) for k, v in m.items()}
    spread = {k: np.zeros_like(v) for k, v in m.items()}
    step = 0
    while step < how.steps:
        order = rng.permutation(len(sizes))
        for at in range(0, len(order), how.batch_docs):
            docs = order[at : at + how.batch_docs]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
            grads = _gradients(m, x[rows], sizes[docs], labels[docs])
            step += 1
            rate = how.rate * max(0.0, 1 - step / (how.steps + 1))
            for k, grad in grads.items():
                grad = grad + how.decay * m[k]
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                spread[k] = 0.999 * spread[k] + 0.001 * grad * grad
                move = (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
                m[k] = (m[k] - rate * move).astype(np.float32)
    return m


def encoded(texts: list[str | None], encoding: Encoding) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the number of passages of each text."""
    parts = list(PassageEncoder(encoding).chunks(texts))
    if not parts:
        return np.zeros((0, encoding.width), np.float32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int) -> DataFrame:
    """doc_id, text and label of at most ``max_docs`` labelled rows, first by hash of the id, one of each id.

    Rows without id or label don't count. Of several labels of an id the smallest holds. The ids
    are at most ``max_docs``, so they are broadcast against the documents.
    """
    known = labels.select(F.col("doc_id"), F.col(label).alias("label")).dropna()
    drawn = (
        known.groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )
    # An id on many rows gives one text, drawn by hash, so the bound holds for rows too.
    text = F.struct(F.xxhash64("text").alias("hash"), "text", "label")
    joined = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(text).alias("first"))
    return joined.select("doc_id", "first.text", "first.label")


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> dict[str, np.ndarray]:
    """The fitted weights. ``docs``: doc_id, text; ``labels``: doc_id, quality (0 or 1)."""
    ship_package(docs.sparkSession)
    labels = pick(labels, doc_id="bigint", quality="int").filter("quality in (0, 1)")
    sample = labelled_sample(
        pick(docs, doc_id="bigint", text="string"), labels, "quality", how.max_docs
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], na_position="first", kind="stable")
        x, sizes = encoded(pdf["text"].tolist(), how.encoding)
        model = fit_bags(x, sizes, pdf["label"].to_numpy(np.float32), how)
        np.savez(out := io.BytesIO(), **model)
        return pd.DataFrame({"model": [out.getvalue()]})

    rows = sample.groupBy(F.lit(0).alias("one")).applyInPandas(run, "model binary").collect()
    if not rows:
        none = np.zeros((0, how.encoding.width), np.float32)
        return fit_bags(none, np.zeros(0, np.int64), np.zeros(0, np.float32), how)
    with np.load(io.BytesIO(bytes(rows[0]["model"]))) as model:
        return {k: model[k] for k in model.files}


def score(docs: DataFrame, model: dict[str, np.ndarray], how: Fit = Fit()) -> DataFrame:
    """doc_id, ``score``, ``n_passages`` and ``attention`` (the largest weight of a passage) for
    every row of ``docs``.

    Only the text is read for a score. A null or empty text is one passage without words. Repeated
    rows and null ids each give a row; an empty table gives an empty result; further columns are
    ignored.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(how.encoding)
        for batch in batches:
            scores, sizes, weights = [], [], []
            for x, n, _ in encoder.chunks(batch.column(1).to_pylist()):
                f = _forward(model, x, n)
                scores.append(f["y"])
                sizes.append(n)
                weights.append(np.maximum.reduceat(f["a"], f["starts"]))
            if scores:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.concatenate(scores).astype(np.float64)),
                        pa.array(np.concatenate(sizes).astype(np.int64)),
                        pa.array(np.concatenate(weights).astype(np.float64)),
                    ],
                    ["doc_id", "score", "n_passages", "attention"],
                )

    kind = "doc_id bigint, score double, n_passages bigint, attention double"
    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, kind)


def score_rows(docs: DataFrame, model: dict[str, np.ndarray], how: Fit = Fit()) -> DataFrame:
    """``docs`` with all its columns and ``quality_score``; see ``score``."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(how.encoding)
        for batch in batches:
            for part in (batch.slice(i, PART_ROWS) for i in range(0, len(batch), PART_ROWS)):
                texts = part.column(at).to_pylist()
                scores = [_forward(model, x, n)["y"] for x, n, _ in encoder.chunks(texts)]
                found = pa.array(np.concatenate(scores).astype(np.float64))
                yield part.append_column("quality_score", found)

    kind = StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])
    return docs.mapInArrow(run, kind)


def quality_scores(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), folds: int = 5) -> DataFrame:
    """``score`` of all documents by a model that has learned from labels outside fold 0 only,
    with ``held_out`` for fold 0."""
    learned = labels.filter(fold_of(F.col("doc_id"), folds) != 0)
    scored = score(docs, train(docs, learned, how), how)
    return scored.withColumn("held_out", fold_of(F.col("doc_id"), folds) == 0)
