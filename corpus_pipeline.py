"""From raw documents to sampled pieces: five stages, each over all that the one before has kept.

Every stage is written as Parquet to the shared folder and read again before the next begins, so a
lost executor repeats part of one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat.llm import attention, mixing, near_dedup, piece_sampling, secrets
from creditfeat.llm.common import stage, table

#: Share of tokens of each domain after mixing; what is good stays as it is and sets the total.
TARGETS = {"good": 0.94, "poor": 0.01, "toxic": 0.05}
THRESHOLD = 0.3

#: No stage but the first two could be put into SQL; see tests/llm for the brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more stay. Rows that share an id are judged one
    by one on their texts."""
    labels = table(spark, sf_dir, "labels")
    model = attention.train(docs, labels)
    judged = attention.score_rows(docs, model)
    return judged.filter(F.col("quality_score") >= THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest id. Four words make a shingle, as in
    the query of near duplicates, so both agree on what a near duplicate is."""
    return near_dedup.without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as their fitted rates say."""
    mixed = mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS)
    copies = mixed.groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    joined = docs.join(copies, docs["doc_id"].eqNullSafe(copies["doc_id"])).drop(copies["doc_id"])
    repeated = joined.filter("_copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))
    )
    return repeated.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with whether they decode to the very text."""
    vocabulary = piece_sampling.load_vocabulary()
    keyed = docs.withColumn("text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    kept = ["lang", "source", "text_crc32"]
    both = piece_sampling.encode(keyed, vocabulary, keep=kept, decoded=True)
    return both.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("bigint").alias("n_pieces"),
        "ids",
        (F.crc32(F.encode("text", "UTF-8")) == F.col("text_crc32")).alias("lossless"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
