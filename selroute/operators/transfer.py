"""Source-by-target transfer matrices: how well one model's rejector ranks another model's answers.

Every score is rated against the labels of all targets. The labels of a row are brought together once, as counts of positives and
negatives by target; a score then carries them as a whole, so what moves through the shuffles is rows x sources, never rows x
sources x targets. Equal scores of a source are added up by target before the first shuffle, running totals are taken for all
targets in one sorted pass, and only the finished cells of the matrix become rows. Targets are a catalogue of models; more than
``TARGETS_AT_ONCE`` of them are taken in slices, which bounds the width of a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selroute.functions.scores import sigmoid
from selroute.operators.ordering import ROWS_PER_BUCKET, value_running
from selroute.session import durable

TARGETS_AT_ONCE = 32


def aligned(scores: DataFrame, labels: DataFrame, row_keys: Sequence[str], label: str = "label") -> DataFrame:
    """Pair every score with every label of the same row; rows without a label drop out first.

    ``scores`` holds (row_keys, source, logit), ``labels`` holds (row_keys, target, label). The join is on
    the row key, so the fan-out of a row is sources x targets whatever the row count is. For the pairs themselves; statistics
    of all pairs are cheaper by ``transfer_metrics`` and ``pair_means``.
    """
    return scores.join(labels.where(F.col(label).isNotNull()), list(row_keys))


def _target_names(labels: DataFrame, label: str) -> list[str]:
    """The catalogue of targets: as many names as there are models."""
    known = labels.where(F.col(label).isNotNull() & F.col("target").isNotNull())
    return sorted(r["target"] for r in known.select("target").distinct().collect())


def _label_counts(labels: DataFrame, row_keys: Sequence[str], targets: Sequence[str], label: str) -> DataFrame:
    """(row_keys, pos_<i>, neg_<i>): labels of each row by target, in one aggregate that combines before its shuffle."""
    positive = F.col(label) == 1
    mine = [(F.col("target") == t) & F.col(label).isNotNull() for t in targets]
    return labels.where(F.col("target").isin(list(targets))).groupBy(*row_keys).agg(
        *[F.count(F.when(m & positive, 1)).alias(f"__pos_{i}") for i, m in enumerate(mine)],
        *[F.count(F.when(m & ~positive, 1)).alias(f"__neg_{i}") for i, m in enumerate(mine)],
    )


def _by_target(
    scores: DataFrame,
    labels: DataFrame,
    row_keys: Sequence[str],
    label: str,
    cells: Callable[[DataFrame, int], tuple[DataFrame, list[dict[str, Column]]]],
    keys: Sequence[str],
) -> DataFrame:
    """One row per (keys, target). ``cells`` turns the scores with their label counts into one row per keys and, for each of the
    targets, the columns of its cell; cells without any labelled row are left out."""
    names = _target_names(labels, label)
    out = None
    for start in range(0, len(names), TARGETS_AT_ONCE):
        part = names[start : start + TARGETS_AT_ONCE]
        counts = _label_counts(labels, row_keys, part, label)
        rows, columns = cells(scores.join(counts, list(row_keys)), len(part))
        structs = [F.struct(F.lit(t).alias("target"), *[c.alias(n) for n, c in cell.items()]) for t, cell in zip(part, columns, strict=True)]
        found = rows.select(*keys, F.inline(F.array(*structs))).where("__rows > 0").drop("__rows")
        out = found if out is None else out.unionByName(found)
    if out is None:  # no label at all
        rows, columns = cells(scores.join(_label_counts(labels, row_keys, ["none"], label), list(row_keys)), 1)
        out = rows.select(*keys, F.lit("none").alias("target"), *[c.alias(n) for n, c in columns[0].items()]).drop("__rows").limit(0)
    return out


def transfer_metrics(
    scores: DataFrame,
    labels: DataFrame,
    row_keys: Sequence[str],
    group: Sequence[str] = (),
    logit: str = "logit",
    label: str = "label",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Metric bundle for each (group, source, target): AUROC, average precision, Brier score and accuracy at one half."""
    keys = [*group, "source"]

    def cells(joined: DataFrame, n: int):
        known = joined.where(F.col(logit).isNotNull()).withColumn("__p", sigmoid(F.col(logit).cast("double")))
        measures = {f"{kind}_{i}": F.col(f"__{kind}_{i}") for i in range(n) for kind in ("pos", "neg")}
        runs = value_running(known, keys, "__p", measures, True, rows_per_bucket)
        sums, out, p = [], [], F.col("__p")
        for i in range(n):
            pos, neg = F.col(f"pos_{i}").cast("double"), F.col(f"neg_{i}").cast("double")
            tp, fp = F.col(f"pos_{i}_upto"), F.col(f"neg_{i}_upto")
            n_pos, n_neg = F.col(f"pos_{i}_total"), F.col(f"neg_{i}_total")
            sums += [
                F.sum(pos * (n_neg - fp) + pos * neg * 0.5).alias(f"wins_{i}"),
                F.sum(pos / F.nullif(n_pos, F.lit(0)) * F.try_divide(tp, tp + fp)).alias(f"ap_{i}"),
                F.sum(pos * F.pow(p - 1, F.lit(2.0)) + neg * F.pow(p, F.lit(2.0))).alias(f"squared_{i}"),
                F.sum(F.when(p >= 0.5, F.col(f"pos_{i}")).otherwise(F.col(f"neg_{i}"))).alias(f"right_{i}"),
                F.max(n_pos).alias(f"n_pos_{i}"),
                F.max(n_neg).alias(f"n_neg_{i}"),
            ]
            wins, ap, squared, right, n_pos, n_neg = (F.col(f"{c}_{i}") for c in ("wins", "ap", "squared", "right", "n_pos", "n_neg"))
            both, total = (n_pos > 0) & (n_neg > 0), n_pos + n_neg
            out.append(
                {
                    "auroc": F.when(both, wins / (n_pos.cast("double") * n_neg)), "aupr": F.when(both, ap),
                    "brier": F.try_divide(squared, total), "accuracy": F.try_divide(right, total), "n_pos": n_pos, "n_neg": n_neg,
                    "__rows": total,
                }
            )
        return runs.groupBy(*keys).agg(*sums), out

    return _by_target(scores, labels, row_keys, label, cells, keys)


def pair_means(
    scores: DataFrame, labels: DataFrame, row_keys: Sequence[str], group: Sequence[str] = (), logit: str = "logit", label: str = "label"
) -> DataFrame:
    """(group, source, target, n, n_pos, mean_logit): number, positives and mean score of all pairs of a score and a label."""
    keys = [*group, "source"]

    def cells(joined: DataFrame, n: int):
        each = [(F.col(f"__pos_{i}"), F.col(f"__pos_{i}") + F.col(f"__neg_{i}")) for i in range(n)]
        scored = F.col(logit).isNotNull().cast("long")
        sums = joined.groupBy(*keys).agg(
            *[F.sum(c).alias(f"n_{i}") for i, (_, c) in enumerate(each)],
            *[F.sum(p).alias(f"n_pos_{i}") for i, (p, _) in enumerate(each)],
            *[F.try_divide(F.sum(F.col(logit) * c), F.sum(scored * c)).alias(f"mean_{i}") for i, (_, c) in enumerate(each)],
        )
        out = [{"n": F.col(f"n_{i}"), "n_pos": F.col(f"n_pos_{i}"), "mean_logit": F.col(f"mean_{i}"), "__rows": F.col(f"n_{i}")} for i in range(n)]
        return sums, out

    return _by_target(scores, labels, row_keys, label, cells, keys)


def misaligned_rows(scores: DataFrame, labels: DataFrame, row_keys: Sequence[str]) -> DataFrame:
    """Scored rows that have no label row at all; a positional zip would have shifted them silently."""
    return scores.join(labels.select(*row_keys).distinct(), list(row_keys), "left_anti")


def fill_missing(
    matrix: DataFrame, group: Sequence[str] = (), value: str = "auroc", impute: str = "target"
) -> DataFrame:
    """Complete the source x target grid and fill the holes with row medians.

    ``impute="target"`` gives a hole in column t the median of *row* t, which is what filling a frame by
    column label with row medians does; ``impute="source"`` uses the row the hole is in.
    """
    if impute not in ("target", "source"):
        raise ValueError("impute must be 'target' or 'source'")
    keys = list(group) or ["__all"]
    # The matrix is small (models squared) but its rows cost a pass over all scores, and it is read four times.
    cells = durable(matrix.select(*group, "source", "target", value))
    cells = cells if group else cells.withColumn("__all", F.lit(0))
    # Model names per group: as long as the catalogue of models, never as long as the data.
    targets = cells.groupBy(*keys).agg(F.array_sort(F.collect_set("target")).alias("__targets"))
    sources = cells.select(*keys, "source").distinct()
    grid = sources.join(targets, keys).select(*keys, "source", F.explode("__targets").alias("target"))
    # A matrix row has one value per model, so the exact built-in median holds no more than that.
    medians = cells.groupBy(*keys, F.col("source").alias(impute)).agg(F.median(value).alias("__median"))
    filled = (
        grid.join(cells.select(*keys, "source", "target", value), [*keys, "source", "target"], "left")
        .join(medians, [*keys, impute], "left")
        .withColumn(value, F.coalesce(value, "__median"))
    )
    return filled.select(*group, "source", "target", value)


def transfer_summary(filled: DataFrame, value: str = "auroc") -> DataFrame:
    """Per model: means, best partners in both roles, its own cell, and the two gaps."""
    v = F.col(value)

    def best(name: str):
        return F.min_by(F.struct(F.col(name).alias("name"), v.alias("value")), F.struct(-v, F.col(name)))

    as_source = filled.groupBy(F.col("source").alias("name")).agg(
        F.avg(v).alias("mean_as_source"),
        best("target").alias("__bt"),
        F.max(F.when(F.col("source") == F.col("target"), v)).alias("in_domain_performance"),
    )
    as_target = filled.groupBy(F.col("target").alias("name")).agg(
        F.avg(v).alias("mean_as_target"), best("source").alias("__bs")
    )
    return as_source.join(as_target, "name", "left").select(
        "name",
        "mean_as_source",
        "mean_as_target",
        F.col("__bt.name").alias("best_target_name"),
        F.col("__bt.value").alias("best_target_value"),
        F.col("__bs.name").alias("best_source_name"),
        F.col("__bs.value").alias("best_source_value"),
        "in_domain_performance",
        (F.col("in_domain_performance") - F.col("__bt.value")).alias("diff_in_domain_minus_best_target"),
        (F.col("in_domain_performance") - F.col("mean_as_source")).alias("diff_in_domain_minus_mean_as_source"),
    )


def profile_distances(filled: DataFrame, value: str = "auroc") -> DataFrame:
    """Mean absolute difference between the rows of the matrix, one row per unordered pair of sources.

    The work is models squared times models; the evaluated rows were reduced to the matrix before.
    """
    left = filled.select("target", F.col("source").alias("source_a"), F.col(value).alias("__a"))
    right = filled.select("target", F.col("source").alias("source_b"), F.col(value).alias("__b"))
    return (
        left.join(right, "target")
        .where("source_a < source_b")
        .groupBy("source_a", "source_b")
        .agg(F.avg(F.abs(F.col("__a") - F.col("__b"))).alias("distance"))
    )


def reordered(filled: DataFrame, order: DataFrame, value: str = "auroc") -> DataFrame:
    """Give each cell its row and column position; ``order`` holds (model, position)."""
    rows = order.select(F.col("model").alias("source"), F.col("position").alias("source_position"))
    cols = order.select(F.col("model").alias("target"), F.col("position").alias("target_position"))
    return filled.join(rows, "source").join(cols, "target").select(
        "source", "target", "source_position", "target_position", value
    )
