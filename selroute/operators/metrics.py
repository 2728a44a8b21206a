"""Exact ranking metrics for any grouping, from one running count over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selroute.functions.scores import sigmoid
from selroute.operators.ordering import ROWS_PER_BUCKET, row_running, seeded_digest, value_running


def threshold_counts(
    df: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    label: str = "label",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per (keys, distinct score): positives and negatives there, at or above it, and in the group.

    Columns: ``pos, neg, tp, fp, n_pos, n_neg``. Rows without score or label take no part.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    positive = (F.col(label) == 1).cast("long")
    runs = value_running(
        known, keys, score, {"pos": positive, "neg": F.lit(1) - positive}, descending=True, rows_per_bucket=rows_per_bucket
    )
    return runs.select(
        *keys,
        score,
        "pos",
        "neg",
        F.col("pos_upto").alias("tp"),
        F.col("neg_upto").alias("fp"),
        F.col("pos_total").alias("n_pos"),
        F.col("neg_total").alias("n_neg"),
    )


def _auroc() -> Column:
    wins = F.sum(
        F.col("pos").cast("double") * (F.col("n_neg") - F.col("fp")) + F.col("pos").cast("double") * F.col("neg") * 0.5
    )
    pairs = F.max("n_pos").cast("double") * F.max("n_neg")
    return F.try_divide(wins, F.nullif(pairs, F.lit(0.0)))


def _average_precision() -> Column:
    step = F.col("pos").cast("double") / F.nullif(F.col("n_pos"), F.lit(0))
    return F.sum(step * F.col("tp") / (F.col("tp") + F.col("fp")))


def _both_classes(value: Column) -> Column:
    return F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), value)


def auroc(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", **kw) -> DataFrame:
    """Area under the ROC curve with ties counted half; NULL for a group with one class only."""
    counts = threshold_counts(df, keys, score, label, **kw)
    return counts.groupBy(*keys).agg(
        _auroc().alias("auroc"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")
    )


def ranking_pair(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", **kw) -> DataFrame:
    """AUROC and step-wise average precision; NULL for a group with one class only."""
    counts = threshold_counts(df, keys, score, label, **kw)
    return counts.groupBy(*keys).agg(
        _auroc().alias("auroc"), _both_classes(_average_precision()).alias("aupr")
    )


def eval_metrics(
    df: DataFrame, keys: Sequence[str], logit: str = "logit", label: str = "label", **kw
) -> DataFrame:
    """AUROC, average precision, Brier score and accuracy at one half, from logits, in one plan."""
    scored = df.withColumn("__p", sigmoid(F.col(logit).cast("double"))).select(*keys, "__p", label)
    counts = threshold_counts(scored, keys, "__p", label, **kw)
    p, total = F.col("__p"), F.max("n_pos") + F.max("n_neg")
    squared = F.sum(F.col("pos") * F.pow(p - 1, F.lit(2.0)) + F.col("neg") * F.pow(p, F.lit(2.0)))
    right = F.sum(F.when(p >= 0.5, F.col("pos")).otherwise(F.col("neg")))
    return counts.groupBy(*keys).agg(
        _auroc().alias("auroc"),
        _both_classes(_average_precision()).alias("aupr"),
        (squared / total).alias("brier"),
        (right / total).alias("accuracy"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
    )


def training_metrics(
    df: DataFrame, keys: Sequence[str], logit: str = "logit", label: str = "label", **kw
) -> DataFrame:
    """Accuracy and AUROC read straight from logits (a logit of zero is a probability of one half)."""
    counts = threshold_counts(df, keys, logit, label, **kw)
    right = F.sum(F.when(F.col(logit) >= 0, F.col("pos")).otherwise(F.col("neg")))
    return counts.groupBy(*keys).agg(
        (right / (F.max("n_pos") + F.max("n_neg"))).alias("accuracy"), _auroc().alias("roc_auc")
    )


def pointwise_metrics(df: DataFrame, keys: Sequence[str], probability: str, label: str = "label") -> DataFrame:
    """Brier score and accuracy at one half; no ordering is needed, so one partial aggregate suffices."""
    p, y = F.col(probability), F.col(label)
    known = df.where(p.isNotNull() & y.isNotNull())
    return known.groupBy(*keys).agg(
        F.avg(F.pow(p - y, F.lit(2.0))).alias("brier"),
        F.avg(((p >= 0.5).cast("int") == y).cast("int")).alias("accuracy"),
    )


def roc_points(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", **kw) -> DataFrame:
    """False and true positive rate at every distinct score."""
    counts = threshold_counts(df, keys, score, label, **kw)
    return counts.select(
        *keys,
        F.col(score).alias("threshold"),
        (F.col("fp") / F.nullif(F.col("n_neg"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0))).alias("tpr"),
    )


def coverage_curve(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    score: str = "score",
    label: str = "label",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Accuracy of the most confident share of the rows, one output row per input row.

    Equal scores are ordered by the digest of the row id, so even one huge run of ties splits evenly. Every row is placed by
    running totals in one pass; there is no join on the score.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    rows = known.select(*keys, score, row_id, label).withColumn("__digest", seeded_digest("tie", row_id))
    measures = {"__row": F.lit(1), "__hit": (F.col(label) == 1).cast("long")}
    ranked = row_running(rows, keys, score, "__digest", [row_id], measures, rows_per_bucket)
    rank = F.col("__row_upto")
    return ranked.select(
        *keys,
        row_id,
        rank.cast("long").alias("rank"),
        (rank / F.col("__row_total")).alias("coverage"),
        (F.col("__hit_upto") / rank).alias("accuracy"),
    )


def threshold_sweep(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", **kw) -> DataFrame:
    """Accuracy of ``score >= t`` for every distinct score, from running counts instead of a t x rows join."""
    counts = threshold_counts(df, keys, score, label, **kw)
    right = F.col("tp") + F.col("n_neg") - F.col("fp")
    return counts.select(
        *keys,
        F.col(score).cast("double").alias("threshold"),
        right.alias("n_right"),
        (right / (F.col("n_pos") + F.col("n_neg"))).alias("accuracy"),
    )


def best_threshold(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best cut of a sweep; the lowest threshold wins a tie."""
    best = F.max(F.struct(F.col("n_right"), (-F.col("threshold")).alias("__low"), F.col("accuracy")))
    return sweep.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, (-F.col("__b.__low")).alias("threshold"), F.col("__b.accuracy").alias("accuracy")
    )
