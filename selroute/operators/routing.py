"""Routing policies: which model answers a prompt, and how accurate the choice is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selroute.operators.reshape import normalise_model_name
from selroute.operators.selection import coverage_edges_grid, elbow_keep, greedy_coverage, usage_curve
from selroute.operators.transfer import fill_missing
from selroute.session import durable

TAU_STEPS = 100
SEARCH_ROUNDS = 20


def best_scored(scores: DataFrame, sample: Sequence[str], score: str = "logit", tie: Column | None = None) -> DataFrame:
    """Model with the greatest score per sample; ties go to the lowest ``tie`` (model name by default).

    An aggregate with map-side combine, so a sample never has to be sorted.
    """
    tie = F.col("model") if tie is None else tie
    known = scores.where(F.col(score).isNotNull())
    return known.groupBy(*sample).agg(F.min_by("model", F.struct(-F.col(score), tie, F.col("model"))).alias("model"))


def keep_models(scores: DataFrame, kept: DataFrame, group: Sequence[str]) -> DataFrame:
    """Restrict the scores to the kept models and carry their ``pick_order`` as tie key.

    ``kept`` has at most one row per model and group.
    """
    return scores.join(kept.select(*group, "model", "pick_order"), [*group, "model"])


def chosen_accuracy(
    routes: DataFrame, correct: DataFrame, sample: Sequence[str], group: Sequence[str] = (), missing: str = "null"
) -> DataFrame:
    """Mean correctness of the chosen models.

    ``missing="zero"`` counts an unknown cell as wrong; ``missing="null"`` makes the whole accuracy unknown
    as soon as one chosen cell is.
    """
    if missing not in ("zero", "null"):
        raise ValueError("missing must be 'zero' or 'null'")
    cells = routes.join(correct.select(*sample, "model", "correct"), [*sample, "model"], "left")
    if missing == "zero":
        value = F.avg(F.coalesce(F.col("correct"), F.lit(0)).cast("double"))
    else:
        value = F.when(F.count("correct") == F.count(F.lit(1)), F.avg(F.col("correct").cast("double")))
    return cells.groupBy(*group).agg(value.alias("accuracy"))


def elbow_routes(scores: DataFrame, sample: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Route once, keep the models before the knee of the usage curve, route again among them."""
    kept = elbow_keep(usage_curve(best_scored(scores, [*group, *sample]), group), group)
    return best_scored(keep_models(scores, kept, group), [*group, *sample], tie=F.col("pick_order"))


def _picked_models(picks: DataFrame, group: Sequence[str]) -> DataFrame:
    return picks.select(*group, normalise_model_name(F.col("source")).alias("model"), F.col("step").alias("pick_order"))


def coverage_picks(
    matrix: DataFrame, group: Sequence[str], tau: float | DataFrame, rounds: int
) -> tuple[DataFrame, DataFrame]:
    """Greedy picks of each group of a transfer matrix; see ``greedy_coverage``.

    ``tau`` is one number or a table (group, tau) with a value per group.
    """
    filled = durable(fill_missing(matrix, group))
    universe = filled.select(*group, "target").distinct()
    cut = filled.join(tau, list(group)) if isinstance(tau, DataFrame) else filled.withColumn("tau", F.lit(float(tau)))
    edges = cut.where(F.col("auroc") >= F.col("tau")).select(*group, "source", "target")
    return greedy_coverage(edges, universe, group, rounds)


def coverage_routes(scores: DataFrame, picks: DataFrame, sample: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Route among the picked models; ties go to the earlier pick."""
    kept = _picked_models(picks, group)
    return best_scored(keep_models(scores, kept, group), [*group, *sample], tie=F.col("pick_order"))


def tau_search(
    matrix: DataFrame,
    bank_scores: DataFrame,
    bank_correct: DataFrame,
    sample: Sequence[str],
    group: Sequence[str],
    rounds: int = SEARCH_ROUNDS,
    steps: int = TAU_STEPS,
) -> DataFrame:
    """Accuracy on the bank for each tau: (group, tau, accuracy), 0 where nothing is picked.

    Taus that lead to the same picks are routed once: the pick lists are grouped before any bank row is
    touched.
    """
    group = list(group)
    filled = durable(fill_missing(matrix, group))
    grid = [*group, "tau"]
    edges = coverage_edges_grid(filled, steps)
    taus = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: i / F.lit(float(steps)))
    universe = filled.select(*group, "target").distinct().withColumn("tau", F.explode(taus))
    picks, _ = greedy_coverage(edges, universe, grid, rounds)
    # Pick lists hold at most one entry per model.
    lists = picks.groupBy(*grid).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "source"))), lambda p: p["source"]).alias("__list")
    )
    shapes = lists.groupBy(*group, "__list").agg(F.min("tau").alias("__shape"))  # the lowest tau stands for its list
    shaped = shapes.select(*group, "__shape", F.posexplode("__list").alias("step", "source"))
    kept = _picked_models(shaped, [*group, "__shape"])
    routed = best_scored(
        bank_scores.join(kept, [*group, "model"]), [*group, "__shape", *sample], tie=F.col("pick_order")
    )
    scored = chosen_accuracy(routed, bank_correct, [*sample], [*group, "__shape"])
    every = universe.select(*grid).distinct()
    return (
        every.join(lists, grid, "left")
        .join(shapes, [*group, "__list"], "left")
        .join(scored, [*group, "__shape"], "left")
        .select(*grid, F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
    )


def best_tau(search: DataFrame, group: Sequence[str]) -> DataFrame:
    """Lowest tau with the greatest accuracy."""
    return search.groupBy(*group).agg(F.min_by("tau", F.struct(-F.col("accuracy"), F.col("tau"))).alias("tau"))


def best_single_model(correct: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean correctness per model, best first; the first row is the best-single-model bound."""
    return correct.groupBy(*group, "model").agg(F.avg("correct").alias("accuracy")).orderBy(*group, F.desc("accuracy"), "model")


def oracle_accuracy(correct: DataFrame, sample: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Share of samples that at least one model gets right (samples without any value do not count)."""
    per_sample = correct.groupBy(*group, *sample).agg(F.max("correct").alias("__best"))
    return per_sample.groupBy(*group).agg(F.avg("__best").alias("accuracy"))


def strategy_summary(results: DataFrame, by: str = "strategy") -> DataFrame:
    """Mean accuracy per strategy over the runs, lowest first."""
    return results.groupBy(by).agg(F.avg("accuracy").alias("mean_accuracy")).orderBy("mean_accuracy", by)
