"""Ranking and threshold metrics over encoded scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat import schemas
from creditfeat.catalog import Catalog
from creditfeat.catalog.encoding import _PRIORS, _TE_COLUMNS, _te_sql
from creditfeat.catalog.fixtures import applicants_sql, folds_sql, labelled, split_sql
from creditfeat.functions import features
from creditfeat.operators import metrics, profile
from creditfeat.operators.encoders import TargetEncoder
from creditfeat.operators.folds import with_split
from creditfeat.operators.isotonic import pooled_curve
from creditfeat.staging import stage

CATALOG = Catalog()
CATEGORIES = schemas.TARGET_ENCODED
WEIGHTS = [0.4, 0.3, 0.2, 0.1]
SCORES = [f"{c}_p" for c in CATEGORIES]

SCORED = f"""{applicants_sql(_TE_COLUMNS)}, {folds_sql(name="train")}, {_PRIORS},
    {", ".join(_te_sql(c, "fold") for c in CATEGORIES)},
    encoded AS (SELECT t.customer_ref, t."default", t.fold,
        {", ".join(f"coalesce(e_{c}.v, p.g) AS {c}_p" for c in CATEGORIES)}
      FROM train t JOIN priors p ON p.f = t.fold
      {" ".join(f"LEFT JOIN enc_{c} e_{c} ON e_{c}.category = t.{c} AND e_{c}.f = t.fold"
                for c in CATEGORIES)}),
    scored AS (SELECT *, {" + ".join(
        f"{s} * {w}::DOUBLE" for s, w in zip(SCORES, WEIGHTS, strict=True))} AS p FROM encoded)"""

COUNTS = f"""{SCORED},
    counts AS (SELECT p, count(*) AS n, sum("default") AS pos, count(*) - sum("default") AS neg
      FROM scored GROUP BY p),
    totals AS (SELECT sum(pos)::BIGINT AS all_pos, sum(neg)::BIGINT AS all_neg FROM counts),
    roc AS (SELECT p AS threshold, (sum(pos) OVER d)::BIGINT AS tp, (sum(neg) OVER d)::BIGINT AS fp,
        all_pos, all_neg FROM counts, totals WINDOW d AS (ORDER BY p DESC))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold encodings as scores, and a blend ``p`` of them; staged once."""
    train = stage(labelled(spark, sf_dir, CATEGORIES), "folded")
    encoder = TargetEncoder.fit(train, CATEGORIES, "default", "fold")
    encoded = encoder.transform(train, "oof", suffix="_p").drop(*CATEGORIES)
    return stage(encoded.withColumn("p", metrics.blend(SCORES, WEIGHTS)), "scored")


@CATALOG.query(f"WITH {SCORED} SELECT customer_ref, p FROM scored")
def blend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("customer_ref", "p")


@CATALOG.query(
    f"""WITH {COUNTS}
    SELECT *, tp::DOUBLE / all_pos AS tpr, fp::DOUBLE / all_neg AS fpr FROM roc"""
)
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_points(scored(spark, sf_dir), "p", "default")


@CATALOG.query(
    f"""WITH {COUNTS},
    c AS (SELECT row_number() OVER (ORDER BY p) AS i, p, n, pos, sum(n) OVER (ORDER BY p) AS cn,
        sum(pos) OVER (ORDER BY p) AS cp FROM counts),
    pairs AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.pos)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS m
      FROM c a JOIN c b ON b.i >= a.i),
    least AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM pairs),
    fitted AS (SELECT k AS i, max(m) AS value FROM least GROUP BY k)
    SELECT min(p) AS low, max(p) AS high, value, sum(n)::BIGINT AS weight
    FROM fitted JOIN c USING (i) GROUP BY value"""
)
def isotonic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The isotonic fit of the label on the score; the twin is the max-min formula over all scores."""
    return pooled_curve(scored(spark, sf_dir), "p", "default")


_AUC = """sum(pos::DOUBLE * (2 * below + neg)) / (2.0 * sum(pos)::DOUBLE * sum(neg)::DOUBLE)"""


@CATALOG.query(
    f"""WITH {COUNTS}, ranked AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counts)
    SELECT round({_AUC}, 9) AS auc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg
    FROM ranked"""
)
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.auc(scored(spark, sf_dir), "p", "default")
    return found.withColumn("auc", F.round("auc", 9))


@CATALOG.query(
    f"""WITH {COUNTS}
    SELECT threshold, tp::DOUBLE / all_pos AS tpr, fp::DOUBLE / all_neg AS fpr,
      tp::DOUBLE / all_pos - fp::DOUBLE / all_neg AS j FROM roc
    ORDER BY tp * all_neg - fp * all_pos DESC, threshold DESC LIMIT 1"""
)
def youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold (one row is the result)."""
    return metrics.youden(metrics.roc_points(scored(spark, sf_dir), "p", "default"))


@CATALOG.query(
    f"""WITH {COUNTS}
    SELECT threshold, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / all_pos AS recall,
      2 * tp::DOUBLE / (tp + fp + all_pos) AS f1 FROM roc
    ORDER BY f1 DESC, threshold DESC LIMIT 1"""
)
def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_f1(metrics.roc_points(scored(spark, sf_dir), "p", "default"))


@CATALOG.query(
    f"""WITH {COUNTS}
    SELECT threshold, tp, fp, ((all_pos - tp) * 100 + fp * 10)::DOUBLE AS cost FROM roc
    ORDER BY cost, threshold DESC LIMIT 1"""
)
def cost_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cost_threshold(metrics.roc_points(scored(spark, sf_dir), "p", "default"))


_CUT = 0.335
_DECIDED = f"""{SCORED}, decided AS (SELECT "default" AS y, (p >= {_CUT})::INT AS d FROM scored),
    cm AS (SELECT count(*) FILTER (y = 0 AND d = 0) AS tn, count(*) FILTER (y = 0 AND d = 1) AS fp,
      count(*) FILTER (y = 1 AND d = 0) AS fn, count(*) FILTER (y = 1 AND d = 1) AS tp
      FROM decided)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("pred", features.decide(F.col("p"), _CUT))


@CATALOG.query(f"WITH {_DECIDED} SELECT tn, fp, fn, tp FROM cm")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_decided(spark, sf_dir), "default", "pred")


@CATALOG.query(
    f"""WITH {_DECIDED}, rates AS (
      SELECT '0' AS class, tn::DOUBLE / (tn + fn) AS p, tn::DOUBLE / (tn + fp) AS r, tn + fp AS n
      FROM cm UNION ALL
      SELECT '1', tp::DOUBLE / (tp + fp), tp::DOUBLE / (tp + fn), tp + fn FROM cm),
    classes AS (SELECT class, p, r, 2 * p * r / (p + r) AS f, n FROM rates),
    report AS (SELECT * FROM classes
      UNION ALL SELECT 'accuracy', a, a, a, n FROM (
        SELECT (tn + tp)::DOUBLE / (tn + fp + fn + tp) AS a, tn + fp + fn + tp AS n FROM cm)
      UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(n) FROM classes
      UNION ALL SELECT 'weighted avg', sum(p * n) / sum(n), sum(r * n) / sum(n),
        sum(f * n) / sum(n), sum(n) FROM classes)
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
      n::BIGINT AS support FROM report"""
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.class_report(_decided(spark, sf_dir), "default", "pred")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@CATALOG.query(
    f"""WITH {SCORED},
    counts AS (SELECT fold, p, sum("default") AS pos, count(*) - sum("default") AS neg
      FROM scored GROUP BY fold, p),
    ranked AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY p
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counts),
    aucs AS (SELECT fold, {_AUC} AS a FROM ranked GROUP BY fold)
    SELECT count(*) AS folds, round(avg(a), 6) AS mean_auc, round(stddev_samp(a), 6) AS sd_auc,
      round(avg(a) - 1.96 * stddev_samp(a), 6) AS low,
      round(avg(a) + 1.96 * stddev_samp(a), 6) AS high FROM aucs"""
)
def fold_auc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.fold_auc_summary(scored(spark, sf_dir), "p", "default", "fold")
    return found.withColumns(
        {c: F.round(c, 6) for c in ("mean_auc", "sd_auc", "low", "high")}
    )


@CATALOG.query(
    f"""WITH {COUNTS}, run AS (SELECT *, sum(n) OVER d AS cn, sum(pos) OVER d AS cp,
        sum(n) OVER () AS an, sum(pos) OVER () AS ap FROM counts WINDOW d AS (ORDER BY p DESC)),
    cuts AS (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS rejection_rate)
    SELECT rejection_rate, rejection_rate * an AS rejected,
      round(cp - pos + (rejection_rate * an - (cn - n)) * pos / n, 6) AS captured,
      round((cp - pos + (rejection_rate * an - (cn - n)) * pos / n) / ap, 9) AS capture_rate
    FROM run, cuts WHERE cn - n < rejection_rate * an AND cn >= rejection_rate * an"""
)
def gains_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.gains_table(scored(spark, sf_dir), "p", "default")
    return found.withColumns(
        {"captured": F.round("captured", 6), "capture_rate": F.round("capture_rate", 9)}
    )


@CATALOG.query(
    f"""WITH {SCORED}, ranks AS (SELECT p, "default" AS y, rank() OVER (ORDER BY p DESC) AS rank,
        percent_rank() OVER (ORDER BY p DESC) AS percent_rank, count(*) OVER () AS an FROM scored)
    SELECT p AS score, count(*) AS n, sum(y)::BIGINT AS pos, rank,
      round(percent_rank, 9) AS percent_rank,
      (floor((rank - 1) * 10 / an) + 1)::INT AS decile
    FROM ranks GROUP BY p, rank, percent_rank, an"""
)
def score_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.score_ranks(scored(spark, sf_dir), "p", "default")
    return found.withColumn("percent_rank", F.round("percent_rank", 9))


_GRID_SQL = f"""{SCORED},
    grid AS (SELECT a, b, 10 - a - b AS c, row_number() OVER (ORDER BY a, b) - 1 AS weight_id
      FROM range(11) x(a), range(11) y(b) WHERE a + b <= 10),
    blends AS (SELECT weight_id, "default" AS y, {SCORES[0]} * (a / 10.0::DOUBLE)
        + {SCORES[1]} * (b / 10.0::DOUBLE) + {SCORES[2]} * (c / 10.0::DOUBLE) AS p
      FROM scored, grid),
    counts AS (SELECT weight_id, p, sum(y) AS pos, count(*) - sum(y) AS neg
      FROM blends GROUP BY weight_id, p),
    ranked AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY weight_id ORDER BY p
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counts),
    aucs AS (SELECT weight_id, {_AUC} AS auc FROM ranked GROUP BY weight_id)"""


@CATALOG.query(
    f"""WITH {_GRID_SQL}
    SELECT weight_id::INT AS weight_id, a / 10.0::DOUBLE AS w1, b / 10.0::DOUBLE AS w2,
      c / 10.0::DOUBLE AS w3, round(auc, 9) AS auc FROM aucs JOIN grid USING (weight_id)"""
)
def weight_grid_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.weight_grid_auc(scored(spark, sf_dir), SCORES[:3], "default")
    return found.select(
        "weight_id",
        *[F.col("weights")[i].alias(f"w{i + 1}") for i in range(3)],
        F.round("auc", 9).alias("auc"),
    )


@CATALOG.query(
    f"""WITH {_GRID_SQL}
    SELECT weight_id::INT AS weight_id, a / 10.0::DOUBLE AS w1, b / 10.0::DOUBLE AS w2,
      c / 10.0::DOUBLE AS w3, round(auc, 9) AS auc FROM aucs JOIN grid USING (weight_id)
    ORDER BY aucs.auc DESC, weight_id LIMIT 1"""
)
def best_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of the grid (one row is the result)."""
    found = metrics.weight_grid_auc(scored(spark, sf_dir), SCORES[:3], "default")
    return metrics.best_weights(found).select(
        "weight_id",
        *[F.col("weights")[i].alias(f"w{i + 1}") for i in range(3)],
        F.round("auc", 9).alias("auc"),
    )


_RUN = {"n_trials": 50, "n_folds": 5, "n_models": 3}


@CATALOG.query(
    f"""WITH {SCORED}, {split_sql("scored")},
    counts AS (SELECT split, p, sum("default") AS pos, count(*) - sum("default") AS neg
      FROM parted GROUP BY split, p),
    ranked AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY split ORDER BY p
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counts),
    aucs AS (SELECT split, {_AUC} AS auc FROM ranked GROUP BY split),
    sides AS (SELECT max(auc) FILTER (split = 'train') AS train_auc,
      max(auc) FILTER (split = 'test') AS test_auc FROM aucs),
    single AS (SELECT state_p AS p, sum("default") AS pos, count(*) - sum("default") AS neg
      FROM parted WHERE split = 'train' GROUP BY state_p),
    below AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM single),
    oof AS (SELECT {_AUC} AS oof_auc FROM below),
    roc AS (SELECT p, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS ap,
        sum(neg) OVER () AS an FROM counts WHERE split = 'test' WINDOW d AS (ORDER BY p DESC)),
    best AS (SELECT p AS optimal_threshold FROM roc ORDER BY tp * an - fp * ap DESC, p DESC LIMIT 1)
    SELECT round(train_auc, 9) AS train_auc, round(test_auc, 9) AS test_auc, optimal_threshold,
      round(train_auc - test_auc, 9) AS train_test_gap, train_auc - test_auc < 0.05 AS gap_ok,
      test_auc >= 0.9 AS auc_ok, round(oof_auc, 9) AS oof_auc,
      {", ".join(f"{v}::INT AS {n}" for n, v in _RUN.items())} FROM sides, best, oof"""
)
def evaluation_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend on both splits, one encoding as the out-of-fold score, and the run's configuration."""
    parted = stage(with_split(scored(spark, sf_dir), "customer_ref", "default"), "parted")
    record = metrics.evaluation_record(parted, "p", "default", "split", oof_score="state_p", run=_RUN)
    return record.withColumns(
        {c: F.round(c, 9) for c in ("train_auc", "test_auc", "train_test_gap", "oof_auc")}
    )


@CATALOG.query(
    f"""WITH {SCORED}
    SELECT 'p' AS "column", count(p) AS n, round(avg(p), 9) AS mean, round(stddev_pop(p), 9) AS std,
      round(median(p), 9) AS median, round(sum(p), 4) AS total FROM scored"""
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.summary_stats(scored(spark, sf_dir), ["p"])
    return stats.withColumns(
        {c: F.round(c, 9) for c in ("mean", "std", "median")} | {"total": F.round("total", 4)}
    )
