"""Rules that turn metrics, overlap scores and entailment decisions into correctness labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selroute.functions.documents import key_signature, prompt_text, rule_table
from selroute.functions.scores import at_least, blend, nan_to_null, to_binary

# The metric that decides each task, and the cut-off of each metric.
TASK_METRIC = {
    "legalbench": "stats_quasi_exact_match",
    "mmlu": "stats_exact_match",
    "narrative_qa": "stats_f1_score",
    "commonsense": "stats_exact_match",
    "wmt_14": "stats_bleu_4",
    "gsm": "stats_final_number_exact_match",
    "math": "stats_math_equiv_chain_of_thought",
    "med_qa": "stats_quasi_exact_match",
    "natural_qa": "stats_f1_score",
}
METRIC_THRESHOLD = {
    "stats_quasi_exact_match": 1.0,
    "stats_exact_match": 1.0,
    "stats_f1_score": 0.6,
    "stats_bleu_4": 0.2,
    "stats_final_number_exact_match": 1.0,
    "stats_math_equiv_chain_of_thought": 1.0,
}
OVERLAP_METRICS = ("stats_f1_score", "stats_bleu_4")

# The grids of the composite rules and of the blends.
BLEU_GRID = (0.05, 0.1, 0.2, 0.3, 0.4)
F1_GRID = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
ALPHA_GRID = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Constant lookup inside the projection; NULL for an unknown key."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def task_metric(task: Column) -> Column:
    return lookup(task, TASK_METRIC)


def metric_threshold(metric: Column, f1: float | None = None, bleu: float | None = None) -> Column:
    table = dict(METRIC_THRESHOLD)
    if f1 is not None:
        table["stats_f1_score"] = float(f1)
    if bleu is not None:
        table["stats_bleu_4"] = float(bleu)
    return lookup(metric, table)


def _metric_value(metric: Column, columns: Sequence[str]) -> Column:
    chain = F.lit(None).cast("double")
    for name in reversed(columns):
        chain = F.when(metric == name, F.col(name).cast("double")).otherwise(chain)
    return chain


def threshold_label(
    df: DataFrame,
    f1: float | None = None,
    bleu: float | None = None,
    override: str | None = None,
    out: str = "correct",
) -> DataFrame:
    """Label each answer by its task's metric; a missing metric is wrong (0).

    ``override`` names a ready-made rule column used for the overlap-scored tasks; its missing values stay
    missing. Rows of unknown tasks get NULL.
    """
    metric = task_metric(F.col("task"))
    columns = [m for m in METRIC_THRESHOLD if m in df.columns]
    hit = at_least(_metric_value(metric, columns), metric_threshold(metric, f1, bleu)).cast("int")
    if override is not None:
        hit = F.when(metric.isin(*OVERLAP_METRICS), F.col(override).cast("int")).otherwise(hit)
    return df.withColumn(out, F.when(metric.isNotNull(), hit))


def rule_name(op: str, bleu: float, f1: float) -> str:
    return f"{op}_{bleu}_{f1}"


def composite_rules(
    df: DataFrame, ids: Sequence[str], bleu: str = "bleu_complete", f1: str = "f1_complete"
) -> DataFrame:
    """All OR / AND rules over the two grids in long form: (ids, rule, op, bleu, f1, value).

    The grid is a constant array exploded next to each row, so nothing is shuffled and no wide table of
    ninety columns appears. A missing score fails its comparison.
    """
    grid = [
        F.struct(F.lit(rule_name(op, b, f)).alias("rule"), F.lit(op).alias("op"), F.lit(b).alias("bleu_cut"), F.lit(f).alias("f1_cut"))
        for b in BLEU_GRID
        for f in F1_GRID
        for op in ("or", "and")
    ]
    rows = df.select(*ids, F.col(bleu).alias("__b"), F.col(f1).alias("__f"), F.inline(F.array(*grid)))
    over_b = at_least(F.col("__b"), F.col("bleu_cut"))
    over_f = at_least(F.col("__f"), F.col("f1_cut"))
    value = F.when(F.col("op") == "or", over_b | over_f).otherwise(over_b & over_f)
    return rows.select(*ids, "rule", "op", "bleu_cut", "f1_cut", value.cast("int").alias("value"))


def blends(df: DataFrame, ids: Sequence[str], bleu: str = "bleu_complete", f1: str = "f1_complete") -> DataFrame:
    """Weighted blends, row maximum and row minimum in long form: (ids, rule, value)."""
    b, f = nan_to_null(F.col(bleu).cast("double")), nan_to_null(F.col(f1).cast("double"))
    named = [
        F.struct(F.lit(f"alpha_{a}").alias("rule"), blend(f, b, F.lit(a)).alias("value")) for a in ALPHA_GRID
    ]
    named.append(F.struct(F.lit("combo_max").alias("rule"), F.greatest(b, f).alias("value")))
    named.append(F.struct(F.lit("combo_min").alias("rule"), F.least(b, f).alias("value")))
    return df.select(*ids, F.inline(F.array(*named)))


def _plain_labels(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    """(kept, __overlap, __plain): whether a row's task is scored by overlap, and its label if not."""
    metric = task_metric(F.col("task"))
    columns = [m for m in METRIC_THRESHOLD if m in df.columns and m not in OVERLAP_METRICS]
    plain = nan_to_null(_metric_value(metric, columns)).cast("int")
    return df.select(*kept, metric.isin(*OVERLAP_METRICS).alias("__overlap"), plain.alias("__plain"))


def composite_label(df: DataFrame, ids: Sequence[str], bleu: str = "bleu_complete", f1: str = "f1_complete") -> DataFrame:
    """One label per row and composite rule: overlap-scored tasks use the rule, the others their metric."""
    rules = composite_rules(_plain_labels(df, [*ids, bleu, f1]), [*ids, "__overlap", "__plain"], bleu, f1)
    return rules.select(
        *ids, "rule", F.when(F.col("__overlap"), F.col("value")).otherwise(F.col("__plain")).alias("correct")
    )


def composite_label_list(
    df: DataFrame, ids: Sequence[str], rules: Sequence[str], bleu: str = "bleu_complete", f1: str = "f1_complete"
) -> DataFrame:
    """(ids, labels): the labels ``composite_label`` gives a row under the listed rules, in their order; NULL under an unknown rule."""
    cells = {rule_name(op, b, f): (op, b, f) for b in BLEU_GRID for f in F1_GRID for op in ("or", "and")}
    grid = F.array(*[F.struct(*[F.lit(x).cast(t).alias(n) for x, t, n in zip(cells.get(r, (None,) * 3), ("string", "double", "double"), "obf", strict=True)]) for r in rules])

    def label(cell: Column) -> Column:
        over_b, over_f = at_least(F.col(bleu), cell["b"]), at_least(F.col(f1), cell["f"])
        value = F.when(cell["o"] == "or", over_b | over_f).otherwise(over_b & over_f).cast("int")
        return F.when(cell["o"].isNotNull(), F.when(F.col("__overlap"), value).otherwise(F.col("__plain")))

    return _plain_labels(df, [*ids, bleu, f1]).select(*ids, F.transform(grid, label).alias("labels"))


def dispatch_documents(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Attach (fields, metric) by the key signature of each document; NULL where no rule knows it."""
    rules = F.broadcast(rule_table(df.sparkSession))  # a constant table of nine rows
    return df.withColumn("signature", key_signature(F.col(doc))).join(rules, "signature", "left")


def prepare_prompts(df: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(prompts, quarantine): documents of known schema with prompt text and 0/1 correctness, and the rest."""
    routed = dispatch_documents(df, doc)
    metrics = ["exact_match", "acc_norm", "acc", "prompt_level_loose_acc", "em"]
    value = F.lit(None).cast("string")
    for name in metrics:
        if name in df.columns:
            value = F.when(F.col("metric") == name, F.col(name).cast("string")).otherwise(value)
    known = (
        routed.where(F.col("metric").isNotNull())
        .withColumn("input", prompt_text(F.try_parse_json(F.col(doc)), F.col("fields")))
        .withColumn("correctness", to_binary(value))
        .drop("signature", "fields")
    )
    unknown = routed.where(F.col("metric").isNull()).drop("fields", "metric")
    return known, unknown
