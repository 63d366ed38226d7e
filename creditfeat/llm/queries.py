"""One query for each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat.catalog import Catalog
from creditfeat.llm import (
    attention,
    bisector,
    class_lm,
    mixing,
    near_dedup,
    onebit,
    periodic,
    piece_sampling,
    quality_rules,
    secrets,
    sharding,
    suffix_repeats,
    warc,
)
from creditfeat.llm.common import table
from creditfeat.staging import fresh_path

CATALOG = Catalog()


@CATALOG.query()
def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labels)


@CATALOG.query()
def op2_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@CATALOG.query()
def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = piece_sampling.load_vocabulary()
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    both = piece_sampling.encode(docs, vocabulary, keep=["text_crc32"], decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.crc32(F.encode("text", "UTF-8")).alias("decoded_crc32"),
        (F.crc32(F.encode("text", "UTF-8")) == F.col("text_crc32")).alias("lossless"),
    )


@CATALOG.query()
def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_assignment(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve_index",
    )


_OP5 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
         strlen(coalesce(html, ''))::BIGINT AS payload_bytes
  FROM pages
), m AS (
  SELECT page_id, payload_bytes, payload_digest,
         CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM m
"""


@CATALOG.query(_OP5)
def op5_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.plan_records(table(spark, sf_dir, "pages"))
    archives = warc.write_archives(records, fresh_path(spark, "warc"))
    return warc.read_archives(archives, payloads=False).select(
        warc.page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


@CATALOG.query()
def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_scores(table(spark, sf_dir, "documents"))


@CATALOG.query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@CATALOG.query()
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind) for kind in secrets.BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(*secrets.BASE_KINDS)))
        .cast("bigint")
        .alias("n_confirmed"),
    )


@CATALOG.query()
def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = attention.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return scored.select(
        "doc_id",
        "held_out",
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        "n_passages",
        "attention",
    )


@CATALOG.query()
def op10_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


@CATALOG.query()
def op11_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_repeats.cut_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _op12_sql(how: bisector.Clusters) -> str:
    """The rounds one after the other, with all distances."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda e: floor({how.scale} * e::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {how.dims}
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {how.dims}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS p
  FROM (SELECT sha256('{how.seed}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL)
  ORDER BY h, x LIMIT {how.k}
)""",
    ]
    for i in range(how.rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS m
  FROM (SELECT r, c, list_sum(list_transform(list_zip(x, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM v, c{i})
  GROUP BY r
)"""
        )
        if i < how.rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(q, p) AS p FROM c{i} LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM (
      SELECT m.c AS c, i, sum(x[i]) AS s, count(*) AS n
      FROM a{i} JOIN v USING (r), range(1, {how.dims + 1}) AS t(i) GROUP BY ALL
    ) GROUP BY c
  ) USING (c)
)"""
            )
    last = how.rounds
    return f"""WITH {", ".join(steps)}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance,
       (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(p, ',')) AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN c{last} ON c{last}.c = m.c"""


@CATALOG.query(_op12_sql(bisector.Clusters()))
def op12_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bisector.centroid_clusters(table(spark, sf_dir, "embeddings"))
    found = found.withColumns({c: F.col(c).cast("bigint") for c in ("cluster_inertia", "inertia")})
    return found.withColumn("centroid_sha256", bisector.point_hash(F.col("centroid"))).drop("centroid")


@CATALOG.query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_repeats(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", periodic.strongest(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
