"""Entailment-style labelling: pair building, pluggable scoring, class labels and the four decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selroute.functions.scores import arg_max_name, nan_to_null
from selroute.functions.text import boxed_answer, correct_option, first_reference
from selroute.operators.overlap import score_token_f1

# Order of the class scores, and the pairs of labels that count as agreement.
CLASS_NAMES = ("contradiction", "entailment", "neutral")
DECISIONS = ("Vee", "Eee", "Ven", "Een")


def entailment_pairs(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Both directions of every (prediction, reference) of the rows that have an overlap metric.

    Output: (row_id, ref_pos, direction, premise, hypothesis); direction 0 is prediction to reference.
    """
    has_metric = nan_to_null(F.col("stats_f1_score")).isNotNull() | nan_to_null(F.col("stats_bleu_4")).isNotNull()
    refs = df.where(has_metric).select(row_id, "predicted_text", F.posexplode("references").alias("ref_pos", "__ref"))
    return refs.select(row_id, "ref_pos", *_both_ways(F.col("predicted_text"), F.col("__ref.output.text")))


def _both_ways(pred: Column, ref: Column) -> list[Column]:
    def way(direction: int, premise: Column, hypothesis: Column) -> Column:
        return F.struct(
            F.lit(direction).alias("direction"), premise.alias("premise"), hypothesis.alias("hypothesis")
        )

    return [F.inline(F.array(way(0, pred, ref), way(1, ref, pred)))]


def score_pairs(pairs: DataFrame, predict: Callable[[pd.Series, pd.Series], Sequence[Sequence[float]]]) -> DataFrame:
    """Run a batch scorer (an entailment model) over premise and hypothesis, one Arrow batch at a time.

    ``predict`` returns three class scores per pair in the order of ``CLASS_NAMES``.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for premise, hypothesis in batches:
            yield pd.Series([[float(x) for x in row] for row in predict(premise, hypothesis)])

    return pairs.withColumn("scores", scored("premise", "hypothesis")).drop("premise", "hypothesis")


def overlap_stand_in(pairs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Class scores from token overlap, for use where no entailment model is at hand.

    Not an entailment model: the entailment score is the share of hypothesis tokens found in the premise
    (token-F1 here), contradiction its complement, neutral a fixed middle value.
    """
    keyed = pairs.withColumn("__pair", F.struct(row_id, "ref_pos", "direction"))
    f1 = score_token_f1(keyed, "__pair", "premise", "hypothesis", "__f1")
    scores = F.array(F.lit(1.0) - F.col("__f1"), F.col("__f1"), F.lit(0.4))
    return f1.select(f"__pair.{row_id}", "__pair.ref_pos", "__pair.direction", scores.alias("scores"))


def pair_labels(scored: DataFrame) -> DataFrame:
    return scored.withColumn("label", arg_max_name(F.col("scores"), CLASS_NAMES)).drop("scores")


def decisions(labels: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Vee / Eee: all / any references entail both ways; Ven / Een: the same with one side neutral allowed."""
    per_ref = labels.groupBy(row_id, "ref_pos").agg(
        F.max(F.when(F.col("direction") == 0, F.col("label"))).alias("forth"),
        F.max(F.when(F.col("direction") == 1, F.col("label"))).alias("back"),
    )
    both = (F.col("forth") == "entailment") & (F.col("back") == "entailment")
    soft = (
        both
        | ((F.col("forth") == "entailment") & (F.col("back") == "neutral"))
        | ((F.col("forth") == "neutral") & (F.col("back") == "entailment"))
    )
    return per_ref.groupBy(row_id).agg(
        F.bool_and(both).cast("int").alias("Vee"),
        F.bool_or(both).cast("int").alias("Eee"),
        F.bool_and(soft).cast("int").alias("Ven"),
        F.bool_or(soft).cast("int").alias("Een"),
    )


def add_decisions(df: DataFrame, decided: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Attach the decisions; rows without pairs keep NULL."""
    return df.join(decided, row_id, "left")


def capability_pairs(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Short answers with a known truth: boxed answers of maths, option letters of multiple choice.

    Rows whose answer cannot be read have no pair and are decided 0 by ``capability_check``.
    """
    boxed = df.where(F.col("task") == "math").select(
        row_id, boxed_answer(F.col("predicted_text")).alias("pred"), boxed_answer(first_reference(F.col("references"))).alias("ref")
    )
    letters = df.where(F.col("task") == "commonsense").select(
        row_id, F.col("predicted_text").alias("pred"), correct_option(F.col("references")).alias("ref")
    )
    usable = boxed.unionByName(letters).where(F.col("pred").isNotNull() & F.col("ref").isNotNull())
    return usable.select(row_id, F.lit(0).alias("ref_pos"), *_both_ways(F.col("pred"), F.col("ref")))


def capability_check(df: DataFrame, decided: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Per row: decision ``Een`` (0 when none) against the recorded metric of its task."""
    truth = F.when(F.col("task") == "math", F.col("stats_math_equiv_chain_of_thought")).otherwise(F.col("stats_exact_match"))
    asked = df.where(F.col("task").isin("math", "commonsense")).select(row_id, "task", truth.alias("recorded"))
    joined = asked.join(decided.select(row_id, "Een"), row_id, "left")
    decision = F.coalesce(F.col("Een"), F.lit(0))
    return joined.select(
        row_id, "task", decision.alias("decision"), "recorded", F.coalesce(decision == F.col("recorded"), F.lit(False)).alias("equal")
    )
