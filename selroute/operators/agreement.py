"""How well metrics and rules agree with human labels, and how stable repeated runs are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selroute.functions.scores import histogram_slot
from selroute.operators.metrics import ranking_pair
from selroute.operators.ordering import ROWS_PER_BUCKET, attach, exact_quantiles, first_per_group, seeded_rank, value_running
from selroute.operators.repeats import balanced_sweeps


def metric_rows(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(ids, metric, value) for the listed columns, as doubles, without missing values."""
    doubles = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(list(ids), list(metrics), "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def varying(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Groups whose value is not constant (minimum differs from maximum: no distinct set is built)."""
    return rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).where("__lo < __hi").select(*keys)


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, rank: str = "rank", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Rank of every distinct value per group, ties sharing their mean rank."""
    runs = value_running(df, keys, value, {"__c": F.lit(1)}, descending=False, rows_per_bucket=rows_per_bucket)
    return runs.select(
        *keys, value, (F.col("__c_upto") - (F.col("__c") - 1) / 2).alias(rank), F.col("__c_total").alias(f"{rank}_n")
    )


def spearman(rows: DataFrame, keys: Sequence[str], value: str = "value", label: str = "label", **kw) -> DataFrame:
    """Rank correlation of value and label, on the rows that have both.

    Equal (value, label) pairs are counted first; the ranks are then centred on their exact mean, so the
    sums stay well-conditioned for very large groups.
    """
    both = rows.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    pairs = both.groupBy(*keys, value, label).agg(F.count(F.lit(1)).alias("__w"))
    x = average_ranks(both, keys, value, "__rx", **kw)
    y = average_ranks(both, keys, label, "__ry", **kw)
    joined = attach(pairs.join(x, [*keys, value]), y.drop("__ry_n"), [*keys, label], [value])
    dx = F.col("__rx") - (F.col("__rx_n") + 1) / 2
    dy = F.col("__ry") - (F.col("__rx_n") + 1) / 2
    w = F.col("__w")
    sums = joined.groupBy(*keys).agg(
        F.sum(w * dx * dy).alias("__xy"), F.sum(w * dx * dx).alias("__xx"), F.sum(w * dy * dy).alias("__yy")
    )
    scale = F.sqrt(F.col("__xx") * F.col("__yy"))
    return sums.select(*keys, (F.col("__xy") / F.nullif(scale, F.lit(0.0))).alias("spearman"))


def label_auroc(rows: DataFrame, keys: Sequence[str], value: str = "value", label: str = "label", **kw) -> DataFrame:
    """AUROC and average precision against the label; constant metrics are left out."""
    kept = rows.join(varying(rows, keys, value), list(keys), "left_semi")
    return ranking_pair(kept, keys, value, label, **kw)


def rule_accuracy(rows: DataFrame, keys: Sequence[str], value: str = "value", label: str = "label") -> DataFrame:
    """Share of rows where the rule equals the label."""
    return rows.groupBy(*keys).agg(F.avg((F.col(label) == F.col(value)).cast("int")).alias("accuracy"))


def balanced_accuracy(
    rows: DataFrame, keys: Sequence[str], ids: Sequence[str], repeats: int, value: str = "value", label: str = "label", **kw
) -> DataFrame:
    """Mean and population deviation of best accuracy and threshold over ``repeats`` balanced samples."""
    sweeps = balanced_sweeps(rows, keys, ids, range(repeats), value, label, **kw)
    return sweeps.groupBy(*keys).agg(
        F.avg("accuracy").alias("bal_acc"),
        F.stddev_pop("accuracy").alias("bal_acc_std"),
        F.avg("threshold").alias("threshold"),
        F.stddev_pop("threshold").alias("threshold_std"),
    )


def agreement_report(
    rows: DataFrame, keys: Sequence[str], ids: Sequence[str], repeats: int = 100, value: str = "value", label: str = "label"
) -> DataFrame:
    """All agreement measures side by side; a metric missing from one of them still has its row."""
    keys = list(keys)
    parts = [
        spearman(rows, keys, value, label),
        label_auroc(rows, keys, value, label),
        rule_accuracy(rows, keys, value, label).withColumnRenamed("accuracy", "unbal_acc"),
        balanced_accuracy(rows, keys, ids, repeats, value, label),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.join(part, keys, "full")
    return report


def class_histogram(rows: DataFrame, keys: Sequence[str], bins: int, value: str = "value", label: str = "label") -> DataFrame:
    """Row counts per (group, class, equal-width bin) between the group's minimum and maximum."""
    span = rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    slot = histogram_slot(F.col(value), F.col("__lo"), F.col("__hi"), bins)
    return rows.join(span, list(keys)).groupBy(*keys, label, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def best_epochs(results: DataFrame, keys: Sequence[str], value: str = "auroc", epoch: str = "epoch") -> DataFrame:
    """Best epoch per group; the lowest epoch wins a tie. Rows with a missing key belong to no group."""
    complete = results
    for key in keys:
        complete = complete.where(F.col(key).isNotNull())
    averaged = complete.groupBy(*keys, epoch).agg(F.avg(value).alias(value))
    return first_per_group(averaged, list(keys), [-F.col(value), F.col(epoch)])


def epoch_profile(results: DataFrame, value: str = "auroc", epoch: str = "epoch") -> DataFrame:
    """Mean and sample deviation per epoch."""
    return results.groupBy(epoch).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def threshold_grid(results: DataFrame) -> DataFrame:
    """Mean AUROC per (f1, bleu) after taking the best epoch of each model and run."""
    best = best_epochs(results, ["model", "f1", "bleu", "run"])
    return best.groupBy("f1", "bleu").agg(F.avg("auroc").alias("mean"))


def similarity_ranking(results: DataFrame) -> DataFrame:
    """Mean AUROC per similarity rule, best first."""
    best = best_epochs(results, ["model", "similarity", "run"])
    return best.groupBy("similarity").agg(F.avg("auroc").alias("mean_auroc")).orderBy(F.desc("mean_auroc"), "similarity")


def grid_quartiles(results: DataFrame) -> DataFrame:
    """Box-plot numbers of the best-epoch AUROC per (f1, bleu)."""
    best = best_epochs(results, ["model", "f1", "bleu", "run"])
    return exact_quantiles(best, ["f1", "bleu"], "auroc", {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def run_variability(results: DataFrame, draws: int = 100) -> DataFrame:
    """Spread of the mean AUROC when only k of the runs are used, for every k.

    Results are reduced to one row per (run, epoch) before the draws multiply them.
    """
    cells = results.groupBy("run", "epoch").agg(F.sum("auroc").alias("__s"), F.count("auroc").alias("__c"))
    runs = cells.select("run").distinct()
    drawn = seeded_rank(
        runs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))), ["draw"], F.col("draw"), ["run"], rank="__rank", size="__runs"
    )
    # The first k runs of a draw's order are its sample of size k, so one order serves every k.
    chosen = drawn.withColumn("k", F.explode(F.sequence(F.col("__rank"), F.col("__runs")))).select("k", "draw", "run")
    per_epoch = chosen.join(cells, "run").groupBy("k", "draw", "epoch").agg((F.sum("__s") / F.sum("__c")).alias("__m"))
    per_draw = per_epoch.groupBy("k", "draw").agg(F.avg("__m").alias("__mean"))
    return per_draw.groupBy("k").agg(F.stddev_pop("__mean").alias("std_of_means"))
