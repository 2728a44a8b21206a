"""Transfer metrics of all (source, target) pairs against metrics of the paired rows."""

import random

import pytest
from pyspark.sql import functions as F

from selroute.operators import transfer as X
from selroute.operators.metrics import eval_metrics

SOURCES, TARGETS = [f"s{i}" for i in range(4)], [f"t{i}" for i in range(7)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    scores = [(run, row, s, None if rng.random() < 0.03 else round(rng.gauss(0, 1), rng.choice((1, 6)))) for run in (0, 1) for row in range(160) for s in SOURCES]
    labels = [(row, t, None if rng.random() < 0.1 else int(rng.random() < 0.4)) for row in range(5, 170) for t in TARGETS if (row + len(t)) % 11]
    labels += [(7, "t0", 1), (7, "t0", 0)]  # a row may have several labels of one target
    labels += [(row, "always", 1) for row in range(160)] + [(row, "unknown", None) for row in range(160)] + [(300, "stray", 1), (8, None, 1)]
    return (
        spark.createDataFrame(scores, "run int, row_id int, source string, logit double").repartition(3),
        spark.createDataFrame(labels, "row_id int, target string, label int").repartition(3),
    )


def plain(df, *names):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


@pytest.mark.parametrize(("at_once", "rows_per_bucket"), [(32, 1 << 20), (3, 1 << 20), (32, 25)])
def test_metrics_equal_those_of_the_paired_rows(tables, monkeypatch, at_once, rows_per_bucket):
    monkeypatch.setattr(X, "TARGETS_AT_ONCE", at_once)
    scores, labels = tables
    names = ("run", "source", "target", "n_pos", "n_neg", "brier", "accuracy")
    pairs = X.aligned(scores, labels.where("target IS NOT NULL"), ["row_id"])
    want = eval_metrics(pairs, ["run", "source", "target"])
    got = X.transfer_metrics(scores, labels, ["row_id"], ["run"], rows_per_bucket=rows_per_bucket)
    assert plain(got, *names) == plain(want, *names) and got.count() == 2 * 4 * 8
    both = "auroc IS NOT NULL AND aupr IS NOT NULL"
    assert plain(got.where(both), *names, "auroc", "aupr") == plain(want.where(both), *names, "auroc", "aupr")
    assert got.where("auroc IS NULL AND target = 'always'").count() == 8


def test_pair_means_equal_those_of_the_paired_rows(tables):
    scores, labels = tables
    pairs = X.aligned(scores, labels.where("target IS NOT NULL"), ["row_id"])
    want = pairs.groupBy("run", "source", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.avg("logit").alias("mean_logit"))
    names = ("run", "source", "target", "n", "n_pos", "mean_logit")
    assert plain(X.pair_means(scores, labels, ["row_id"], ["run"]), *names) == plain(want, *names)


def test_no_labels_give_no_cells(tables):
    scores, labels = tables
    assert X.transfer_metrics(scores, labels.limit(0), ["row_id"]).count() == 0
    assert X.pair_means(scores, labels.where("label IS NULL"), ["row_id"]).count() == 0
    assert X.transfer_metrics(scores.limit(0), labels, ["row_id"]).count() == 0


def test_targets_never_multiply_the_rows_that_move(spark):
    """The widest exchange carries a row per (source, score); targets become rows behind the last aggregate only."""
    scores = spark.range(2000).selectExpr("id AS row_id", "explode(array('a', 'b')) AS source", "CAST(id * 7919 % 2003 AS DOUBLE) / 500 AS logit")
    labels = spark.range(2000).selectExpr("id AS row_id", "explode(transform(sequence(1, 12), t -> concat('t', CAST(t AS STRING)))) AS target", "CAST(id % 3 = 0 AS INT) AS label")
    found = X.transfer_metrics(scores, labels, ["row_id"])
    assert found.count() == 24
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    first_generate = final.index("Generate inline")
    assert "Join" not in final[:first_generate] and "Window" not in final[:first_generate] and "Window" in final[first_generate:]
