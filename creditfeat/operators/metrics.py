"""Ranking and threshold metrics as DataFrame operators.

All of them start from one row per distinct score, so ties are handled exactly and a
score shared by a third of all rows is one row.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditfeat.operators.ordering import running_totals
from creditfeat.staging import stage


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, n, pos, neg) for every distinct score."""
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )


def _with_totals(df: DataFrame, measures: Sequence[str], by: Sequence[str]) -> DataFrame:
    totals = df.groupBy(*by).agg(*[F.sum(m).alias(f"all_{m}") for m in measures])
    totals = F.broadcast(totals)  # one row per group, and groups are few
    return df.join(totals, list(by)) if by else df.crossJoin(totals)


def roc_points(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, tp, fp, all_pos, all_neg, tpr, fpr), one row per distinct score."""
    counts = stage(score_counts(df, score, label, by), "scores")
    run = running_totals(counts, "score", ["pos", "neg"], by, descending=True)
    return _with_totals(run, ["pos", "neg"], by).select(
        *by,
        F.col("score").alias("threshold"),
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        "all_pos",
        "all_neg",
        F.try_divide("cum_pos", "all_pos").alias("tpr"),
        F.try_divide("cum_neg", "all_neg").alias("fpr"),
    )


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-correct area under the ROC curve: (by, auc, n_pos, n_neg)."""
    return auc_of_counts(score_counts(df, score, label, by), by)


def auc_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As :func:`auc`, from one row per (by, score) with its ``pos`` and ``neg``."""
    run = running_totals(stage(counts, "scores"), "score", ["neg"], by)
    below = F.col("cum_neg").cast("double") * 2 - F.col("neg")  # twice: lower + half of equal
    return (
        run.groupBy(*by)
        .agg(
            F.sum(F.col("pos").cast("double") * below).alias("_wins"),
            F.sum("pos").alias("n_pos"),
            F.sum("neg").alias("n_neg"),
        )
        .select(
            *by,
            F.try_divide(
                F.col("_wins"), F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg")
            ).alias("auc"),
            "n_pos",
            "n_neg",
        )
    )


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(18,0)")


def youden(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest one on ties.

    Compared as tp*N - fp*P in integers, so rounding never decides."""
    gain = _wide("tp") * _wide("all_neg") - _wide("fp") * _wide("all_pos")
    best = F.max_by(
        F.struct("threshold", "tpr", "fpr"), F.struct(gain.alias("g"), F.col("threshold"))
    )
    return points.groupBy(*by).agg(best.alias("b")).select(
        *by,
        F.col("b.threshold").alias("threshold"),
        F.col("b.tpr").alias("tpr"),
        F.col("b.fpr").alias("fpr"),
        (F.col("b.tpr") - F.col("b.fpr")).alias("j"),
    )


def best_f1(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest F1; the highest one on ties."""
    tp, fp, pos = (F.col(c).cast("double") for c in ("tp", "fp", "all_pos"))
    scored = points.withColumns(
        {
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, pos),
            "f1": F.try_divide(2 * tp, tp + fp + pos),
        }
    )
    row = F.struct("threshold", "precision", "recall", "f1")
    return (
        scored.groupBy(*by)
        .agg(F.max_by(row, F.struct("f1", "threshold")).alias("b"))
        .select(*by, "b.*")
    )


def cost_threshold(
    points: DataFrame, cost_fn: int = 100, cost_fp: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Threshold with the least misclassification cost; the highest one on ties."""
    missed = _wide("all_pos") - _wide("tp")
    cost = (missed * F.lit(cost_fn) + _wide("fp") * F.lit(cost_fp)).cast("decimal(38,0)")
    row = F.struct("threshold", "tp", "fp", cost.cast("double").alias("cost"))
    return (
        points.groupBy(*by)
        .agg(F.max_by(row, F.struct((-cost).alias("c"), F.col("threshold"))).alias("b"))
        .select(*by, "b.*")
    )


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, tn, fp, fn, tp)."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return df.groupBy(*by).agg(
        *[
            F.count_if((F.col(label) == y) & (F.col(pred) == p)).alias(name)
            for name, (y, p) in cells.items()
        ]
    )


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(class, precision, recall, f1, support) for both classes, accuracy and averages.

    As in the usual printed report, accuracy fills every rate column."""
    c = confusion(df, label, pred)

    def rates(hit: str, wrong: str, missed: str) -> tuple[Column, Column, Column, Column]:
        h, w, m = (F.col(x).cast("double") for x in (hit, wrong, missed))
        zero = F.lit(0.0)
        return (
            F.coalesce(F.try_divide(h, h + w), zero),
            F.coalesce(F.try_divide(h, h + m), zero),
            F.coalesce(F.try_divide(2 * h, 2 * h + w + m), zero),
            (F.col(hit) + F.col(missed)).cast("long"),
        )

    neg, pos = rates("tn", "fn", "fp"), rates("tp", "fp", "fn")
    rows = neg[3] + pos[3]
    accuracy = (F.col("tn") + F.col("tp")).cast("double") / rows
    macro = [(a + b) / 2 for a, b in zip(neg[:3], pos[:3], strict=True)]
    weighted = [
        (a * neg[3] + b * pos[3]) / rows for a, b in zip(neg[:3], pos[:3], strict=True)
    ]
    lines = [
        ("0", *neg),
        ("1", *pos),
        ("accuracy", accuracy, accuracy, accuracy, rows),
        ("macro avg", *macro, rows),
        ("weighted avg", *weighted, rows),
    ]
    names = ("precision", "recall", "f1", "support")
    structs = [
        F.struct(F.lit(n).alias("class"), *[v.alias(k) for k, v in zip(names, vals, strict=True)])
        for n, *vals in lines
    ]
    return c.select(F.inline(F.array(*structs)))


def fold_auc_summary(df: DataFrame, score: str, label: str, fold: str) -> DataFrame:
    """(folds, mean_auc, sd_auc, low, high): mean, sample deviation, normal 95 % interval."""
    per_fold = auc(df, score, label, [fold])
    mean, sd = F.avg("auc"), F.stddev_samp("auc")
    return per_fold.agg(
        F.count(F.lit(1)).alias("folds"),
        mean.alias("mean_auc"),
        sd.alias("sd_auc"),
        (mean - F.lit(1.96) * sd).alias("low"),
        (mean + F.lit(1.96) * sd).alias("high"),
    )


def gains_table(
    df: DataFrame, score: str, label: str, rates: Sequence[float] = (0.1, 0.2, 0.3)
) -> DataFrame:
    """(rejection_rate, rejected, captured, capture_rate): positives among the
    ``rejection_rate`` highest scores. Rows tied at the cut count pro rata."""
    counts = stage(score_counts(df, score, label), "scores")
    run = _with_totals(
        running_totals(counts, "score", ["n", "pos"], descending=True), ["n", "pos"], []
    )
    cuts = F.array(*[F.lit(float(r)) for r in rates])
    target = F.col("rejection_rate") * F.col("all_n")
    before = F.col("cum_n") - F.col("n")
    return (
        run.withColumn("rejection_rate", F.explode(cuts))
        .where((before < target) & (F.col("cum_n") >= target))
        .select(
            "rejection_rate",
            target.alias("rejected"),
            (
                F.col("cum_pos") - F.col("pos") + (target - before) * F.col("pos") / F.col("n")
            ).alias("captured"),
            "all_pos",
        )
        .withColumn("capture_rate", F.try_divide("captured", "all_pos"))
        .drop("all_pos")
    )


def score_ranks(df: DataFrame, score: str, label: str, n_tiles: int = 10) -> DataFrame:
    """(score, n, pos, rank, percent_rank, decile) by descending score, one row per score.

    The decile is that of the first of the tied rows."""
    counts = stage(score_counts(df, score, label), "scores")
    run = _with_totals(running_totals(counts, "score", ["n"], descending=True), ["n"], [])
    before = F.col("cum_n") - F.col("n")
    share = F.coalesce(F.try_divide(before, F.col("all_n") - 1), F.lit(0.0))
    return run.select(
        "score",
        "n",
        "pos",
        (before + 1).alias("rank"),
        share.alias("percent_rank"),
        (F.floor(before * n_tiles / F.col("all_n")) + 1).cast("int").alias("decile"),
    )


def simplex_grid(n_models: int, steps: int = 10) -> list[tuple[float, ...]]:
    """All weight vectors on a grid with sum 1."""
    cuts = itertools.product(range(steps + 1), repeat=n_models - 1)
    return [
        (*[c / steps for c in cut], (steps - sum(cut)) / steps) for cut in cuts if sum(cut) <= steps
    ]


def blend(scores: Sequence[str], weights: Sequence[float]) -> Column:
    terms = [F.col(s) * F.lit(float(w)) for s, w in zip(scores, weights, strict=True)]
    return sum(terms[1:], terms[0])


def weight_grid_auc(
    df: DataFrame, scores: Sequence[str], label: str, steps: int = 10
) -> DataFrame:
    """AUC of every weighted blend on the grid, in one grouped job:
    (weight_id, weights, auc). Rows are counted per tuple of scores before they are multiplied
    by the grid; a tuple with a null has no blend."""
    grid = simplex_grid(len(scores), steps)
    tuples = (
        df.dropna(subset=list(scores))
        .groupBy(*scores)
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
        )
    )
    blends = F.array(
        *[
            F.struct(F.lit(i).alias("weight_id"), blend(scores, w).alias("score"))
            for i, w in enumerate(grid)
        ]
    )
    counts = (
        tuples.select("pos", "neg", F.inline(blends))
        .groupBy("weight_id", "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    result = auc_of_counts(counts, ["weight_id"])
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in grid])
    return result.select("weight_id", weights[F.col("weight_id")].alias("weights"), "auc")


def best_weights(grid_auc: DataFrame) -> DataFrame:
    """The grid row with the largest AUC; the smallest id on ties."""
    order = F.struct("auc", (-F.col("weight_id")).alias("w"))
    return grid_auc.agg(F.max_by(F.struct("weight_id", "weights", "auc"), order).alias("b")).select(
        "b.*"
    )


def evaluation_record(
    df: DataFrame,
    score: str,
    label: str,
    split: str,
    gap_limit: float = 0.05,
    auc_goal: float = 0.9,
    oof_score: str | None = None,
    run: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row: AUC on both splits, their gap, the test threshold and the two gates. ``oof_score`` adds
    ``oof_auc``, of the out-of-fold scores of the training rows; ``run`` adds its items as columns."""
    record = _evaluation(df, score, label, split, gap_limit, auc_goal)
    if oof_score is not None:
        own = auc(df.where(F.col(split) == "train"), oof_score, label)
        record = record.crossJoin(own.select(F.col("auc").alias("oof_auc")))  # one row each
    return record.withColumns({n: F.lit(int(v)) for n, v in (run or {}).items()})


def _evaluation(
    df: DataFrame, score: str, label: str, split: str, gap_limit: float, auc_goal: float
) -> DataFrame:
    both = auc(df, score, label, [split])
    best = youden(roc_points(df.where(F.col(split) == "test"), score, label))
    return (
        both.agg(
            F.max(F.when(F.col(split) == "train", F.col("auc"))).alias("train_auc"),
            F.max(F.when(F.col(split) == "test", F.col("auc"))).alias("test_auc"),
        )
        .crossJoin(best.select(F.col("threshold").alias("optimal_threshold")))  # one row each
        .withColumn("train_test_gap", F.col("train_auc") - F.col("test_auc"))
        .withColumn("gap_ok", F.col("train_test_gap") < gap_limit)
        .withColumn("auc_ok", F.col("test_auc") >= auc_goal)
    )
