"""Metrics against hand-made cases and brute force, with one bucket and with many."""

import random

import pytest
from pyspark.sql import functions as F

from selroute.operators import agreement as A
from selroute.operators import metrics as M
from selroute.operators.ordering import exact_quantiles, first_per_group, seeded_rank

SCORES = [0.9, 0.8, 0.8, 0.7, 0.4, 0.3, 0.3, 0.1]
LABELS = [1, 0, 1, 0, 1, 0, 0, 1]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def scored(spark, n=400, seed=3, hot=0.4):
    """Two groups; a large part of the first group's rows share one score."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "a" if i % 4 else "b"
        score = 1.5 if rng.random() < hot else round(rng.uniform(-3, 3), 2)
        rows.append((g, i, float(score), int(rng.random() < 0.3 + 0.1 * (score > 0))))
    return rows, frame(spark, rows, "g string, row_id long, score double, label int")


def pair_auroc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def step_ap(rows):
    total, tp, seen, out = sum(y for _, y in rows), 0, 0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        here = [y for s, y in rows if s == t]
        tp, seen = tp + sum(here), seen + len(here)
        out += sum(here) / total * tp / seen
    return out


def test_tied_case(spark):
    df = frame(spark, [("g", s, y) for s, y in zip(SCORES, LABELS)], "g string, score double, label int")
    row = M.ranking_pair(df, ["g"]).first()
    assert row.auroc == pytest.approx(0.59375)
    assert row.aupr == pytest.approx(0.6916667, abs=1e-6)


@pytest.mark.parametrize("per_bucket", [5, 1 << 20])
def test_grouped_metrics_match_brute_force(spark, per_bucket):
    rows, df = scored(spark)
    got = {r.g: r for r in M.ranking_pair(df, ["g"], rows_per_bucket=per_bucket).collect()}
    for g in ("a", "b"):
        own = [(s, y) for k, _, s, y in rows if k == g]
        assert got[g].auroc == pytest.approx(pair_auroc(own))
        assert got[g].aupr == pytest.approx(step_ap(own))


@pytest.mark.parametrize("per_bucket", [7, 1 << 20])
def test_coverage_curve_orders_every_row_once(spark, per_bucket):
    rows, df = scored(spark)
    curve = M.coverage_curve(df, ["g"], "row_id", rows_per_bucket=per_bucket).orderBy("g", "rank").collect()
    score = {i: s for _, i, s, _ in rows}
    label = {i: y for _, i, _, y in rows}
    for g in ("a", "b"):
        own = [r for r in curve if r.g == g]
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert all(score[x.row_id] >= score[y.row_id] for x, y in zip(own, own[1:]))
        hits = 0
        for r in own:
            hits += label[r.row_id]
            assert r.accuracy == pytest.approx(hits / r["rank"])
        assert own[-1].coverage == 1.0


def test_bucket_count_does_not_change_the_curve(spark):
    _rows, df = scored(spark)
    few = M.coverage_curve(df, ["g"], "row_id", rows_per_bucket=9)
    one = M.coverage_curve(df, ["g"], "row_id")
    assert few.exceptAll(one).isEmpty() and one.exceptAll(few).isEmpty()


def test_single_class_group_is_null(spark):
    df = frame(spark, [("g", 0.2, 1), ("g", 0.8, 1)], "g string, logit double, label int")
    row = M.eval_metrics(df, ["g"]).first()
    assert row.auroc is None and row.aupr is None and row.n_neg == 0 and row.n_pos == 2
    assert row.brier is not None


def test_missing_labels_and_scores_are_left_out(spark):
    df = frame(spark, [("g", 0.2, 0), ("g", 0.8, 1), ("g", 0.9, None), ("g", None, 0)], "g string, score double, label int")
    row = M.auroc(df, ["g"]).first()
    assert (row.auroc, row.n_pos, row.n_neg) == (1.0, 1, 1)


def test_auroc_of_negated_scores(spark):
    _rows, df = scored(spark)
    up = {r.g: r.auroc for r in M.auroc(df, ["g"]).collect()}
    down = {r.g: r.auroc for r in M.auroc(df.withColumn("score", -F.col("score")), ["g"]).collect()}
    for g in up:
        assert up[g] + down[g] == pytest.approx(1.0)


def test_threshold_tie_takes_the_lowest(spark):
    df = frame(spark, [("g", 0.1, 1), ("g", 0.2, 0), ("g", 0.3, 1)], "g string, score double, label int")
    row = M.best_threshold(M.threshold_sweep(df, ["g"]), ["g"]).first()
    assert (row.threshold, row.accuracy) == (0.1, pytest.approx(2 / 3))


def test_one_class_sweep(spark):
    df = frame(spark, [("g", 0.2, 0), ("g", 0.8, 0)], "g string, score double, label int")
    row = M.best_threshold(M.threshold_sweep(df, ["g"]), ["g"]).first()
    assert (row.threshold, row.accuracy) == (0.8, 0.5)


@pytest.mark.parametrize("per_bucket", [4, 1 << 20])
def test_quantiles_and_infinite_values(spark, per_bucket):
    values = [5.0, 1.0, 9.0, 9.0, 2.5, 7.0, 3.0]
    df = frame(spark, [("g", v) for v in values] + [("g", None)], "g string, v double")
    row = exact_quantiles(df, ["g"], "v", {"low": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "high": 1.0}, per_bucket).first()
    assert list(row)[1:] == [1.0, 2.75, 5.0, 8.0, 9.0]


@pytest.mark.parametrize("per_bucket", [3, 1 << 20])
def test_seeded_rank_is_the_digest_order(spark, per_bucket):
    import hashlib

    df = spark.range(50)
    got = {r.id: r["rank"] for r in seeded_rank(df, (), 42, ["id"], rows_per_bucket=per_bucket).collect()}
    order = sorted(range(50), key=lambda i: (hashlib.md5(f"42-{i}".encode()).hexdigest(), i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_first_per_group(spark):
    df = frame(spark, [("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in first_per_group(df, ["k"], [F.col("o")]).collect()} == {("a", "y"), ("b", "z")}


@pytest.mark.parametrize("per_bucket", [6, 1 << 20])
def test_spearman_matches_pandas(spark, per_bucket):
    rows, df = scored(spark)
    got = {r.g: r.spearman for r in A.spearman(df, ["g"], "score", "label", rows_per_bucket=per_bucket).collect()}
    pdf = df.toPandas()
    for g, own in pdf.groupby("g"):
        expected = own["score"].rank().corr(own["label"].rank())
        assert got[g] == pytest.approx(expected)


def test_constant_metric_is_skipped_and_spearman_is_null(spark):
    df = frame(spark, [("m", i, 1.0, i % 2) for i in range(4)], "metric string, id int, value double, label int")
    assert A.label_auroc(df, ["metric"]).isEmpty()
    assert A.spearman(df, ["metric"]).first().spearman is None


def test_balanced_samples_keep_whole_classes(spark):
    from selroute.operators.splits import balanced_samples

    rows = [("m", i, float(i), int(i < 5)) for i in range(30)]
    df = frame(spark, rows, "metric string, id long, value double, label int")
    drawn = balanced_samples(df, ["metric"], ["id"], range(3), rows_per_bucket=4)
    sizes = {(r.seed, r.label): r["count"] for r in drawn.groupBy("seed", "label").count().collect()}
    assert sizes == {(s, y): 5 for s in range(3) for y in (0, 1)}


@pytest.mark.parametrize("per_bucket", [3, 1 << 12])
def test_seeded_take_is_the_head_of_the_shuffle(spark, per_bucket):
    from selroute.operators.ordering import seeded_take

    sizes, wanted = {"a": 40, "b": 7, "c": 3}, {"a": 11, "b": 7, "c": 5}
    rows = [(g, i, wanted[g], n) for g, n in sizes.items() for i in range(n)]
    df = frame(spark, rows, "g string, id long, k int, n long")
    got = {(r.g, r.id) for r in seeded_take(df, ["g"], 7, ["id"], "k", "n", per_bucket).collect()}
    ranked = seeded_rank(df, ["g"], 7, ["id"]).where("rank <= k").collect()
    assert got == {(r.g, r.id) for r in ranked} and len(got) == 21


def test_best_epoch_and_missing_keys(spark):
    rows = [("m", 0.1, "r", 1, 0.7), ("m", 0.1, "r", 2, 0.7), ("m", None, "r", 1, 0.9)]
    df = frame(spark, rows, "model string, f1 double, run string, epoch int, auroc double")
    got = A.best_epochs(df, ["model", "f1", "run"]).collect()
    assert [(r.epoch, r.auroc) for r in got] == [(1, 0.7)]


def test_run_variability_ends_at_zero(spark):
    rows = [(run, epoch, 0.5 + 0.1 * run + 0.01 * epoch) for run in range(4) for epoch in range(2)]
    df = frame(spark, rows, "run int, epoch int, auroc double")
    got = {r.k: r.std_of_means for r in A.run_variability(df, 20).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] == pytest.approx(0.0) and got[1] > got[3]
