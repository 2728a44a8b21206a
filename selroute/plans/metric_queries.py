"""Ranking metrics, curves and experiment reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from selroute.functions.scores import sigmoid
from selroute.operators import agreement as A
from selroute.operators import metrics as M
from selroute.operators import transfer as X
from selroute.operators.ordering import first_per_group, value_running
from selroute.operators.reshape import pivot_mean
from selroute.operators.labels import BLEU_GRID
from selroute.plans.registry import query, r6, rounded

_BUNDLE = """round((sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0), 6) AS auroc,
    CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg"""


def _scored(v):
    """Own-model rows only: each model's logits against its own labels."""
    known = v.eval_long.where("correct IS NOT NULL")
    return known.select("model", "row_id", "logit", F.col("correct").alias("label"))


_OWN = "own AS (SELECT model, row_id, logit, correct AS label, 1 / (1 + exp(-logit)) AS p FROM eval_long WHERE correct IS NOT NULL)"


@query("i1_auroc_transfer", "SELECT source, target, round(auroc, 6) AS auroc FROM transfer")
def _(v):
    pairs = X.aligned(v.scores, v.truth, ["row_id"])
    return M.auroc(pairs, ["source", "target"], "logit").select("source", "target", r6("auroc").alias("auroc"))


@query(
    "i2_average_precision",
    f"""WITH {_OWN}, c AS (SELECT model, logit, sum(label) AS pos, count(*) AS n FROM own GROUP BY ALL),
    s AS (SELECT model, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY model) AS np
          FROM c WINDOW w AS (PARTITION BY model ORDER BY logit DESC))
    SELECT model, round(sum(pos / np * tp / seen), 6) AS aupr FROM s GROUP BY 1""",
)
def _(v):
    return rounded(M.ranking_pair(_scored(v), ["model"], "logit").select("model", "aupr"), "aupr")


@query("i3_brier", f"WITH {_OWN} SELECT model, round(avg((p - label) ** 2), 6) AS brier FROM own GROUP BY 1")
def _(v):
    p = _scored(v).withColumn("p", sigmoid(F.col("logit")))
    return rounded(M.pointwise_metrics(p, ["model"], "p").select("model", "brier"), "brier")


@query(
    "i4_accuracy_half",
    f"WITH {_OWN} SELECT model, round(avg(CAST(CAST(p >= 0.5 AS INT) = label AS INT)), 6) AS accuracy FROM own GROUP BY 1",
)
def _(v):
    p = _scored(v).withColumn("p", sigmoid(F.col("logit")))
    return rounded(M.pointwise_metrics(p, ["model"], "p").select("model", "accuracy"), "accuracy")


_BUNDLE_SQL = f"""WITH {_OWN}, rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rk FROM own),
    a AS (SELECT model, {_BUNDLE}, round(avg((p - label) ** 2), 6) AS brier,
          round(avg(CAST(CAST(p >= 0.5 AS INT) = label AS INT)), 6) AS accuracy FROM rk GROUP BY 1),
    c AS (SELECT model, p, sum(label) AS pos, count(*) AS n FROM own GROUP BY ALL),
    s AS (SELECT model, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY model) AS np
          FROM c WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
    ap AS (SELECT model, round(sum(pos / np * tp / seen), 6) AS aupr FROM s GROUP BY 1)
    SELECT a.*, aupr FROM a JOIN ap USING (model)"""


@query("i5_eval_bundle", _BUNDLE_SQL)
def _(v):
    return rounded(M.eval_metrics(_scored(v), ["model"]), "auroc", "aupr", "brier", "accuracy")


@query("i5_eval_bundle_split", _BUNDLE_SQL)
def _(v):
    """The same with groups cut into buckets: no window sees more than a part of a model's scores."""
    return rounded(M.eval_metrics(_scored(v), ["model"], rows_per_bucket=100), "auroc", "aupr", "brier", "accuracy")


@query(
    "i6_roc_points",
    f"""WITH {_OWN}, c AS (SELECT model, logit, sum(label) AS pos, sum(1 - label) AS neg FROM own GROUP BY ALL)
    SELECT model, logit AS threshold,
      round(sum(neg) OVER (PARTITION BY model ORDER BY logit DESC) / sum(neg) OVER (PARTITION BY model), 6) AS fpr,
      round(sum(pos) OVER (PARTITION BY model ORDER BY logit DESC) / sum(pos) OVER (PARTITION BY model), 6) AS tpr FROM c""",
)
def _(v):
    return rounded(M.roc_points(_scored(v), ["model"], "logit"), "fpr", "tpr")


@query(
    "i7_training_metrics",
    f"""WITH {_OWN}, rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY logit) + (count(*) OVER (PARTITION BY model, logit) - 1) / 2.0 AS rk FROM own)
    SELECT model, round(avg(CAST(CAST(logit >= 0 AS INT) = label AS INT)), 6) AS accuracy,
    round((sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0), 6) AS roc_auc FROM rk GROUP BY 1""",
)
def _(v):
    return rounded(M.training_metrics(_scored(v), ["model"]), "accuracy", "roc_auc")


@query("h9_sigmoid", "SELECT row_id, model, round(1 / (1 + exp(-logit)), 6) AS p FROM eval_long")
def _(v):
    return v.eval_long.select("row_id", "model", r6(sigmoid(F.col("logit"))).alias("p"))


@query(
    "e1_coverage_curve",
    f"""WITH {_OWN}, o AS (SELECT model, row_id, label, row_number() OVER w AS rank, sum(label) OVER w AS hits, count(*) OVER (PARTITION BY model) AS n
      FROM own WINDOW w AS (PARTITION BY model ORDER BY logit DESC, md5('tie-' || row_id), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT model, row_id, CAST(rank AS BIGINT) AS rank, round(rank / n, 6) AS coverage, round(hits / rank, 6) AS accuracy FROM o""",
)
def _(v):
    return rounded(M.coverage_curve(_scored(v), ["model"], "row_id", "logit"), "coverage", "accuracy")


@query(
    "e2_best_epoch",
    "SELECT model, f1, bleu, run, epoch, round(auroc, 6) AS auroc FROM best_grid",
)
def _(v):
    return rounded(A.best_epochs(v.results, ["model", "f1", "bleu", "run"]), "auroc")


@query(
    "e5_cumulative_counts",
    f"""WITH {_OWN}, c AS (SELECT model, logit AS score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM own GROUP BY ALL)
    SELECT model, score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp
    FROM c WINDOW w AS (PARTITION BY model ORDER BY score DESC)""",
)
def _(v):
    counts = M.threshold_counts(_scored(v).withColumnRenamed("logit", "score"), ["model"])
    return counts.select("model", "score", "pos", "neg", "tp", "fp")


@query(
    "d1_group_mean",
    "SELECT model, run, round(avg(auroc), 6) AS mean_auroc FROM results GROUP BY ALL",
)
def _(v):
    return v.results.groupBy("model", "run").agg(r6(F.avg("auroc")).alias("mean_auroc"))


@query(
    "d2_epoch_mean_std",
    "SELECT epoch, round(avg(auroc), 6) AS mean, round(stddev_samp(auroc), 6) AS std FROM results GROUP BY 1",
)
def _(v):
    return rounded(A.epoch_profile(v.results), "mean", "std").orderBy("epoch")


@query(
    "d3_mean_of_means",
    "SELECT round(avg(a), 6) AS mean_auroc FROM (SELECT epoch, avg(auroc) AS a FROM results GROUP BY 1)",
)
def _(v):
    return v.results.groupBy("epoch").agg(F.avg("auroc").alias("a")).agg(r6(F.avg("a")).alias("mean_auroc"))


@query(
    "d4_population_std",
    "SELECT model, round(stddev_pop(auroc), 6) AS std FROM results GROUP BY 1",
)
def _(v):
    return v.results.groupBy("model").agg(r6(F.stddev_pop("auroc")).alias("std"))


@query(
    "i16_run_variability",
    """WITH draws AS (SELECT d.draw, r.run, row_number() OVER (PARTITION BY d.draw ORDER BY md5(d.draw || '-' || r.run), r.run) AS rk
      FROM range(100) d(draw), (SELECT DISTINCT run FROM results) r),
    m AS (SELECT k.k, d.draw, s.epoch, avg(s.auroc) AS a FROM draws d JOIN results s USING (run), range(1, 4) k(k) WHERE d.rk <= k.k GROUP BY ALL),
    p AS (SELECT k, draw, avg(a) AS a FROM m GROUP BY ALL)
    SELECT CAST(k AS BIGINT) AS k, round(stddev_pop(a), 6) AS std_of_means FROM p GROUP BY 1""",
)
def _(v):
    return rounded(A.run_variability(v.results, 100), "std_of_means")


@query(
    "i17_threshold_grid",
    "SELECT f1, bleu, round(avg(auroc), 6) AS mean FROM best_grid GROUP BY ALL",
)
def _(v):
    return rounded(A.threshold_grid(v.results), "mean")


@query(
    "i18_similarity_ranking",
    """SELECT similarity, round(avg(auroc), 6) AS mean_auroc FROM (SELECT *, row_number() OVER (PARTITION BY model, similarity, run
      ORDER BY auroc DESC, epoch) AS r FROM results WHERE similarity IS NOT NULL) WHERE r = 1 GROUP BY 1""",
)
def _(v):
    return rounded(A.similarity_ranking(v.results), "mean_auroc")


@query(
    "i19_best_mean_epoch",
    """SELECT epoch, round(mean, 6) AS mean FROM (SELECT epoch, avg(auroc) AS mean FROM results GROUP BY 1) ORDER BY mean DESC, epoch LIMIT 1""",
)
def _(v):
    profile = A.epoch_profile(v.results).select("epoch", "mean", F.lit(0).alias("one"))
    return rounded(first_per_group(profile, ["one"], [-F.col("mean"), F.col("epoch")]).select("epoch", "mean"), "mean")


@query(
    "i21_grid_quartiles",
    """SELECT f1, bleu, round(min(auroc), 6) AS low, round(quantile_cont(auroc, 0.25), 6) AS q1, round(quantile_cont(auroc, 0.5), 6) AS median,
      round(quantile_cont(auroc, 0.75), 6) AS q3, round(max(auroc), 6) AS high FROM best_grid GROUP BY ALL""",
)
def _(v):
    return rounded(A.grid_quartiles(v.results), "low", "q1", "median", "q3", "high")


@query(
    "b14_pivot_mean",
    "SELECT f1, " + ", ".join(f'round(avg(auroc) FILTER (bleu = {b}), 6) AS "{b}"' for b in BLEU_GRID) + " FROM results WHERE f1 IS NOT NULL GROUP BY 1",
)
def _(v):
    wide = pivot_mean(v.results.where("f1 IS NOT NULL"), "f1", "bleu", "auroc", list(BLEU_GRID))
    return wide.select("f1", *[r6(F.col(f"`{b}`")).alias(str(b)) for b in BLEU_GRID])


@query(
    "e4_average_rank",
    """SELECT DISTINCT metric, value, round(rank() OVER (PARTITION BY metric ORDER BY value)
      + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0, 6) AS rank FROM human_long""",
)
def _(v):
    rows = A.metric_rows(v.human, ["doc_id"], ["m1", "m2", "m3"])
    return A.average_ranks(rows, ["metric"], "value").select("metric", "value", r6(F.col("rank").cast("double")).alias("rank"))


def _human(v, *ids):
    return A.metric_rows(v.human, ["doc_id", "label", *ids], ["m1", "m2", "m3"])


_SPEARMAN = """SELECT {k} round(corr(rx, ry), 6) AS spearman FROM (SELECT {k} rank() OVER (PARTITION BY {p} ORDER BY value)
    + (count(*) OVER (PARTITION BY {p}, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {p} ORDER BY label)
    + (count(*) OVER (PARTITION BY {p}, label) - 1) / 2.0 AS ry FROM human_long) GROUP BY ALL"""


@query("i8_spearman", _SPEARMAN.format(k="metric,", p="metric"))
def _(v):
    return rounded(A.spearman(_human(v), ["metric"]), "spearman")


_AUC = """WITH rk AS (SELECT {k}, label, value, rank() OVER (PARTITION BY {k} ORDER BY value)
      + (count(*) OVER (PARTITION BY {k}, value) - 1) / 2.0 AS rk FROM human_long),
    a AS (SELECT {k}, (sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0) AS auroc
      FROM rk GROUP BY ALL HAVING count(DISTINCT value) > 1),
    c AS (SELECT {k}, value, sum(label) AS pos, count(*) AS n FROM human_long GROUP BY ALL),
    s AS (SELECT {k}, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY {k}) AS np
      FROM c WINDOW w AS (PARTITION BY {k} ORDER BY value DESC)),
    p AS (SELECT {k}, sum(pos / nullif(np, 0) * tp / seen) AS ap FROM s GROUP BY ALL)
    SELECT {k}, round(auroc, 6) AS auroc, round(CASE WHEN auroc IS NOT NULL THEN ap END, 6) AS aupr FROM a JOIN p USING ({k})"""


@query("i9_label_auroc", _AUC.format(k="metric"))
def _(v):
    return rounded(A.label_auroc(_human(v), ["metric"]), "auroc", "aupr")


@query("i10_rule_accuracy", "SELECT metric, round(avg(CAST(label = value AS INT)), 6) AS accuracy FROM human_long GROUP BY 1")
def _(v):
    return rounded(A.rule_accuracy(_human(v), ["metric"]), "accuracy")


_SWEEP = """c AS (SELECT {k}, value, sum(label) AS pos, sum(1 - label) AS neg FROM {t} GROUP BY ALL),
    s AS (SELECT {k}, value AS threshold, (sum(pos) OVER w + sum(neg) OVER (PARTITION BY {k}) - sum(neg) OVER w)
      / (sum(pos) OVER (PARTITION BY {k}) + sum(neg) OVER (PARTITION BY {k})) AS accuracy
      FROM c WINDOW w AS (PARTITION BY {k} ORDER BY value DESC))"""
_BEST = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY accuracy DESC, threshold) AS r FROM s) WHERE r = 1)"


@query(
    "i11_threshold_sweep",
    f"WITH {_SWEEP.format(k='metric', t='human_long')} SELECT metric, threshold, round(accuracy, 6) AS accuracy FROM s",
)
def _(v):
    return rounded(M.threshold_sweep(_human(v), ["metric"], "value").drop("n_right"), "accuracy")


@query(
    "i11_best_threshold",
    f"WITH {_SWEEP.format(k='metric', t='human_long')}, {_BEST.format(k='metric')} SELECT metric, threshold, round(accuracy, 6) AS accuracy FROM b",
)
def _(v):
    return rounded(M.best_threshold(M.threshold_sweep(_human(v), ["metric"], "value"), ["metric"]), "accuracy")


def _balanced_sql(seeds: str, keys: str = "metric") -> str:
    on = " AND ".join(f"r.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    return f"""small AS (SELECT {keys}, min(n) AS k FROM (SELECT {keys}, label, count(*) AS n FROM human_long GROUP BY ALL) GROUP BY ALL),
    ranked AS (SELECT h.*, seed, row_number() OVER (PARTITION BY {keys}, seed, label ORDER BY md5(seed || '-' || doc_id), doc_id) AS rk
      FROM human_long h, {seeds}),
    drawn AS (SELECT r.* FROM ranked r JOIN small m ON {on} WHERE r.rk <= m.k)"""


_ONE_SEED = "(VALUES (42)) q(seed)"
_MANY_SEEDS = "range(1000) q(seed)"
_HUNDRED_SEEDS = "range(100) q(seed)"


@query(
    "i12_balanced_sweep",
    f"""WITH {_balanced_sql(_ONE_SEED)}, {_SWEEP.format(k='metric', t='drawn')}, {_BEST.format(k='metric')}
    SELECT metric, threshold, round(accuracy, 6) AS accuracy FROM b""",
)
def _(v):
    return rounded(A.balanced_sweeps(_human(v), ["metric"], ["doc_id"], [42]).drop("seed"), "accuracy")


def _repeated(keys: str, seeds: str) -> str:
    return f"""{_balanced_sql(seeds, keys)}, {_SWEEP.format(k=keys + ', seed', t='drawn')}, {_BEST.format(k=keys + ', seed')},
    bal AS (SELECT {keys}, round(avg(accuracy), 6) AS bal_acc, round(stddev_pop(accuracy), 6) AS bal_acc_std,
      round(avg(threshold), 6) AS threshold, round(stddev_pop(threshold), 6) AS threshold_std FROM b GROUP BY ALL)"""


@query("i13_repeated_balanced", f"WITH {_repeated('metric', _MANY_SEEDS)} SELECT * FROM bal")
def _(v):
    out = A.balanced_accuracy(_human(v), ["metric"], ["doc_id"], 1000)
    return rounded(out, "bal_acc", "bal_acc_std", "threshold", "threshold_std")


@query("i14_sliced_spearman", _SPEARMAN.format(k="task, metric,", p="task, metric").replace("corr(rx, ry)", "CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END"))
def _(v):
    return rounded(A.spearman(_human(v, "task"), ["task", "metric"]), "spearman")


@query("i14_sliced_auroc", _AUC.format(k="task, metric"))
def _(v):
    return rounded(A.label_auroc(_human(v, "task"), ["task", "metric"]), "auroc", "aupr")


@query("i14_sliced_rule_accuracy", "SELECT task, metric, round(avg(CAST(label = value AS INT)), 6) AS accuracy FROM human_long GROUP BY ALL")
def _(v):
    return rounded(A.rule_accuracy(_human(v, "task"), ["task", "metric"]), "accuracy")


@query("i14_sliced_balanced", f"WITH {_repeated('task, metric', _MANY_SEEDS)} SELECT * FROM bal")
def _(v):
    out = A.balanced_accuracy(_human(v, "task"), ["task", "metric"], ["doc_id"], 1000)
    return rounded(out, "bal_acc", "bal_acc_std", "threshold", "threshold_std")


@query(
    "i15_agreement_report",
    f"""WITH {_repeated('metric', _HUNDRED_SEEDS)}, sp AS ({_SPEARMAN.format(k='metric,', p='metric')}),
    au AS ({_AUC.format(k='metric')}),
    un AS (SELECT metric, round(avg(CAST(label = value AS INT)), 6) AS unbal_acc FROM human_long GROUP BY 1)
    SELECT * FROM sp FULL JOIN au USING (metric) FULL JOIN un USING (metric) FULL JOIN bal USING (metric)""",
)
def _(v):
    out = A.agreement_report(_human(v), ["metric"], ["doc_id"], 100)
    names = ("spearman", "auroc", "aupr", "unbal_acc", "bal_acc", "bal_acc_std", "threshold", "threshold_std")
    return rounded(out, *names).orderBy(F.desc("spearman"))


@query(
    "i20_class_histogram",
    """WITH g AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM human_long GROUP BY 1)
    SELECT metric, label, CAST(least(floor((value - lo) / ((hi - lo) / 20.0)), 19) AS INT) AS bin, count(*) AS n
    FROM human_long JOIN g USING (metric) GROUP BY ALL""",
)
def _(v):
    return A.class_histogram(_human(v), ["metric"], 20)


@query("f8_distinct_thresholds", "SELECT DISTINCT metric, value FROM human_long")
def _(v):
    return _human(v).select("metric", "value").distinct().orderBy("metric", "value")


@query(
    "f5_balanced_sample",
    f"WITH {_balanced_sql(_ONE_SEED)} SELECT metric, doc_id, label FROM drawn",
)
def _(v):
    from selroute.operators.splits import balanced_samples

    return balanced_samples(_human(v), ["metric"], ["doc_id"], [42]).select("metric", "doc_id", "label")


@query(
    "f7_run_draws",
    """SELECT CAST(draw AS INT) AS draw, run, CAST(row_number() OVER (PARTITION BY draw ORDER BY md5(draw || '-' || run), run) AS BIGINT) AS place
    FROM range(100) d(draw), (SELECT DISTINCT run FROM results) r""",
)
def _(v):
    from selroute.operators.ordering import seeded_rank

    runs = v.predictions.select("run").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99))))
    return seeded_rank(runs, ["draw"], F.col("draw"), ["run"], rank="place").select("draw", "run", "place")


@query("d6_constant_guard", "SELECT metric FROM human_long GROUP BY 1 HAVING count(DISTINCT value) > 1")
def _(v):
    return A.varying(_human(v), ["metric"])


@query(
    "d7_min_class_count",
    "SELECT metric, min(n) AS min_count FROM (SELECT metric, label, count(*) AS n FROM human_long GROUP BY ALL) GROUP BY 1",
)
def _(v):
    from selroute.operators.splits import class_counts

    return class_counts(_human(v), ["metric"])


@query(
    "c3_full_outer_reports",
    f"""WITH own AS (SELECT * FROM human_long WHERE metric <> 'm1' OR task <> 'src0'), sp AS ({_SPEARMAN.format(k='task, metric,', p='task, metric').replace(
        "corr(rx, ry)", "CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END").replace("human_long", "own")}),
    au AS ({_AUC.format(k='task, metric')}) SELECT task, metric, spearman, auroc, aupr FROM sp FULL JOIN au USING (task, metric)""",
)
def _(v):
    """Correlations of all slices but one beside the areas of the slices whose metric varies; a slice of either report stays."""
    rows = _human(v, "task")
    correlated = A.spearman(rows.where("metric <> 'm1' OR task <> 'src0'"), ["task", "metric"])
    return rounded(correlated.join(A.label_auroc(rows, ["task", "metric"]), ["task", "metric"], "full"), "spearman", "auroc", "aupr")


@query(
    "f1_sorted_ranking",
    "SELECT model, f1, bleu, similarity, run, epoch, round(auroc, 6) AS auroc FROM results",
)
def _(v):
    return rounded(v.results, "auroc").orderBy(F.desc("auroc"), "model", "run", "epoch", "f1", "bleu", "similarity")
