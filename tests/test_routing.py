"""Transfer matrices, model selection, routing and neighbours against brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from selroute.operators import neighbours as K
from selroute.operators import routing as R
from selroute.operators import selection as G
from selroute.operators import transfer as X


def matrix(spark, cells):
    return spark.createDataFrame([(s, t, v) for s, row in cells.items() for t, v in row.items()], "source string, target string, auroc double")


HOLED = {"a": {"a": 0.9, "c": 0.5}, "b": {"a": 0.1, "b": 0.2, "c": 0.3}, "c": {"a": 0.6, "b": 0.7, "c": 0.8}}


def test_median_fill_uses_the_row_of_the_target(spark):
    df = matrix(spark, HOLED)
    by_target = {(r.source, r.target): r.auroc for r in X.fill_missing(df).collect()}
    by_source = {(r.source, r.target): r.auroc for r in X.fill_missing(df, impute="source").collect()}
    assert len(by_target) == 9
    assert by_target["a", "b"] == pytest.approx(0.2) and by_source["a", "b"] == pytest.approx(0.7)


def test_summary_and_distances(spark):
    full = X.fill_missing(matrix(spark, HOLED))
    row = {r.name: r for r in X.transfer_summary(full).collect()}["a"]
    assert row.best_target_name == "a" and row.in_domain_performance == 0.9 and row.best_source_name == "a"
    assert row.mean_as_source == pytest.approx((0.9 + 0.2 + 0.5) / 3)
    far = {(r.source_a, r.source_b): r.distance for r in X.profile_distances(full).collect()}
    assert set(far) == {("a", "b"), ("a", "c"), ("b", "c")} and far["b", "c"] == pytest.approx(0.5)


def test_alignment_drops_missing_labels_and_reports_strays(spark):
    scores = spark.createDataFrame([(1, "s", 0.1), (2, "s", 0.2), (9, "s", 0.3)], "row_id int, source string, logit double")
    labels = spark.createDataFrame([(1, "t", 1), (2, "t", None)], "row_id int, target string, label int")
    assert X.aligned(scores, labels, ["row_id"]).count() == 1
    assert [r.row_id for r in X.misaligned_rows(scores, labels, ["row_id"]).collect()] == [9]


def plain_knee(counts, sensitivity=1.0):
    """Walk along the difference curve as the published description says."""
    n = len(counts)
    if n < 2 or max(counts) == min(counts):
        return None
    x = [i / (n - 1) for i in range(n)]
    y = [(max(counts) - c) / (max(counts) - min(counts)) for c in counts]
    d = [round(b - a, 12) for a, b in zip(x, y)]
    limit = peak = None
    for i in range(n - 1):
        before, after = d[max(i - 1, 0)], d[min(i + 1, n - 1)]
        if d[i] >= before and d[i] >= after:
            limit, peak = d[i] - sensitivity / (n - 1), i
        if d[i] <= before and d[i] <= after:
            limit = 0.0 if peak is not None else limit
        if peak is not None and d[i + 1] < limit:
            return peak
    return None


def test_knee(spark):
    rng = random.Random(5)
    curves = [[100, 50, 20, 10, 5, 4, 3, 2, 1, 1], [5, 4, 3, 2, 1], [7, 7, 7], [9], [100, 99, 98, 2, 1]]
    curves += [sorted((rng.randint(1, 200) for _ in range(rng.randint(2, 15))), reverse=True) for _ in range(40)]
    rows = [(g, i, n) for g, c in enumerate(curves) for i, n in enumerate(c)]
    df = spark.createDataFrame(rows, "g int, position int, n long")
    got = {r.g: r.knee for r in G.knee_points(df, ["g"]).collect()}
    assert got == {g: plain_knee(c) for g, c in enumerate(curves)}
    assert got[0] is not None and got[3] is None


def plain_greedy(edges, targets, rounds):
    left, picks = set(targets), []
    for step in range(1, rounds + 1):
        gain = {s: len(left & set(ts)) for s, ts in edges.items()}
        best = min(gain, key=lambda s: (-gain[s], s)) if gain else None
        if best is None or gain[best] == 0:
            break
        picks.append((step, best, gain[best]))
        left -= set(edges[best])
    return picks


def test_greedy_coverage(spark):
    rng = random.Random(11)
    names = [f"m{i}" for i in range(8)]
    groups = {"x": {"A": ["A", "B"], "B": ["B", "C"], "C": ["C"]}}
    universe = {"x": ["A", "B", "C"]}
    for g in range(4):
        groups[f"g{g}"] = {s: [t for t in names if rng.random() < 0.25] for s in names}
        universe[f"g{g}"] = names
    edges = spark.createDataFrame([(g, s, t) for g, e in groups.items() for s, ts in e.items() for t in ts], "g string, source string, target string")
    all_targets = spark.createDataFrame([(g, t) for g, ts in universe.items() for t in ts], "g string, target string")
    picks, coverage = G.greedy_coverage(edges, all_targets, ["g"], 3)
    got = {}
    for r in picks.orderBy("g", "step").collect():
        got.setdefault(r.g, []).append((r.step, r.source, r.gain))
    assert got == {g: plain_greedy(e, universe[g], 3) for g, e in groups.items()}
    curve = [r.covered for r in coverage.where("g = 'x'").orderBy("step").collect()]
    assert curve == [pytest.approx(2 / 3), 1.0, 1.0]
    for g in groups:
        own = [r.covered for r in coverage.where(F.col("g") == g).orderBy("step").collect()]
        assert len(own) == 3 and own == sorted(own)


def test_route_ties_and_missing_cells(spark):
    scores = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "b", 0.9), (2, "a", None)], "sample_id int, model string, logit double")
    routes = R.best_scored(scores, ["sample_id"])
    assert {r.sample_id: r.model for r in routes.collect()} == {1: "a", 2: "b"}
    kept = spark.createDataFrame([("b", 0), ("a", 1)], "model string, pick_order int")
    again = R.best_scored(R.keep_models(scores, kept, []), ["sample_id"], tie=F.col("pick_order"))
    assert {r.sample_id: r.model for r in again.collect()} == {1: "b", 2: "b"}
    correct = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "sample_id int, model string, correct int")
    assert R.chosen_accuracy(routes, correct, ["sample_id"], missing="zero").first().accuracy == 0.5
    assert R.chosen_accuracy(routes, correct, ["sample_id"], missing="null").first().accuracy is None


def test_tau_search_prefers_the_lowest_tau_and_scores_empty_picks_zero(spark):
    cells = {"a": {"a": 0.55, "b": 0.55}, "b": {"a": 0.3, "b": 0.9}}
    heat = matrix(spark, cells).withColumn("run", F.lit(0))
    scores = spark.createDataFrame([(0, i, m, x) for i in range(4) for m, x in (("a", 1.0), ("b", 0.0))], "run int, sample_id int, model string, logit double")
    correct = spark.createDataFrame([(i, m, c) for i in range(4) for m, c in (("a", int(i < 1)), ("b", 1))], "sample_id int, model string, correct int")
    search = R.tau_search(heat, scores, correct, ["sample_id"], ["run"], rounds=5)
    got = {round(r.tau, 2): r.accuracy for r in search.collect()}
    assert len(got) == 100
    assert got[0.5] == 0.25  # a covers everything and is picked alone
    assert got[0.6] == 1.0 and got[0.9] == 1.0 and got[0.95] == 0.0
    assert R.best_tau(search, ["run"]).first().tau == 0.56


def test_bounds(spark):
    correct = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "a", 0), (2, "b", 0), (3, "a", 0), (3, "b", 1)], "sample_id int, model string, correct int")
    assert R.best_single_model(correct).first().model == "a"
    assert R.oracle_accuracy(correct, ["sample_id"]).first().accuracy == pytest.approx(2 / 3)


@pytest.mark.parametrize("block_rows,pivots", [(6, 4), (8192, 32)])
def test_neighbours_match_brute_force(spark, block_rows, pivots):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 6))
    vectors = np.vstack([centres[i % 5] + 0.2 * rng.normal(size=6) for i in range(110)] + [centres[0]] * 40)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    test, train = df.where("vec_id % 5 = 0 AND vec_id < 110"), df.where("vec_id % 5 <> 0 OR vec_id >= 110")
    found = K.nearest_neighbours(test, train, 7, block_rows=block_rows, pivots=pivots)
    got = {}
    for r in found.orderBy("test_id", "rank").collect():
        got.setdefault(r.test_id, []).append((r.train_id, r.similarity))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = [i for i in range(150) if i % 5 or i >= 110]
    for q in range(0, 110, 5):
        sims = np.round(unit[q] @ unit[ids].T, 9)
        best = sorted(zip(ids, sims), key=lambda p: (-p[1], p[0]))[:7]
        assert [a for a, _ in got[q]] == [a for a, _ in best]
        assert [b for _, b in got[q]] == pytest.approx([b for _, b in best])


def test_block_search_holds_few_similarities_and_returns_what_reaches_the_floor(monkeypatch):
    rng = np.random.default_rng(4)
    units = np.round(rng.normal(size=(300, 3)), 1)
    units[7] = np.nan
    tests = pd.DataFrame({"test_id": np.arange(50), "unit": list(units[100:150]), "floor": np.where(np.arange(50) % 2, 0.5, -np.inf)})
    trains = pd.DataFrame({"train_id": np.arange(300)[::-1], "unit": list(units[::-1])})
    monkeypatch.setattr(K, "_CELLS", 300 * 4)
    held, best = [], K._best
    monkeypatch.setattr(K, "_best", lambda sims, *a: held.append(sims.size) or best(sims, *a))
    found = K._search(9)[0](tests, trains)
    assert max(held) == 300 * 4
    for q in range(50):
        sims = np.round(units[100 + q] @ units.T, 9)
        order = sorted((i for i in range(300) if i != 7), key=lambda i: (-sims[i], i))[:9]
        want = [(i, sims[i]) for i in order if sims[i] >= tests["floor"][q]]
        mine = found[found["test_id"] == q]
        assert list(zip(mine["train_id"], mine["similarity"], strict=True)) == want


def test_fewer_train_rows_than_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    found = K.nearest_neighbours(df.where("vec_id < 2"), df.where("vec_id >= 2"), 40)
    assert found.groupBy("test_id").count().where("count = 4").count() == 2


def test_name_normalisation_and_wide_cells(spark):
    from selroute.operators import reshape as S

    df = spark.createDataFrame([("Org/Model__X",), ("org_model_x",)], "model string")
    assert [r.name for r in S.name_collisions(df).collect()] == ["org_model_x"]
    cells = spark.createDataFrame([(1, "a", 1), (1, "a", 0)], "id int, model string, correct int")
    with pytest.raises(Exception, match="more than one value"):
        S.to_wide(cells, ["id"], "model", "correct", ["a"]).collect()


def slow_cover(covers, targets, rounds):
    """Round by round on sets: (source, gain) and the share covered."""
    left, picks, shares = set(targets), [], []
    for _ in range(rounds):
        best = min(covers, key=lambda s: (-len(covers[s] & left), s), default=None)
        if best is not None and covers[best] & left:
            picks.append((best, len(covers[best] & left)))
            left -= covers[best]
        shares.append(1 - len(left) / len(targets))
    return picks, shares


@pytest.mark.parametrize("n", [1, 5, 63, 64, 65, 130])
def test_cover_equals_set_search_for_catalogues_of_any_width(spark, n):
    rng = random.Random(n)
    names = [f"t{i:03}" for i in range(n)]
    covers = {(g, f"s{i:03}"): set(rng.sample(names, rng.randrange(0, max(2, n // 3)) if n > 2 else 1)) for g in range(4) for i in range(n // 2 + 3)}
    edges = [(g, s, t) for (g, s), ts in covers.items() for t in ts if g != 3]  # nothing is covered in the last group
    df = spark.createDataFrame(edges, "g int, source string, target string")
    universe = spark.createDataFrame([(g, t) for g in range(4) for t in names], "g int, target string")
    picks, coverage = G.greedy_coverage(df, universe, ["g"], 9)
    for g in range(4):
        own = {s: ts for (h, s), ts in covers.items() if h == g} if g != 3 else {}
        want, shares = slow_cover(own, names, 9)
        got = [(r.source, r.gain) for r in picks.where(f"g = {g}").orderBy("step").collect()]
        assert got == want
        assert [r.covered for r in coverage.where(f"g = {g}").orderBy("step").collect()] == pytest.approx(shares)


def test_cover_is_one_job_without_written_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(G, "durable", lambda df: written.append(df) or df)
    edges = spark.createDataFrame([(s, t) for s in "abc" for t in "xyz"], "source string, target string")
    picks, coverage = G.greedy_coverage(edges, edges.select("target").distinct(), [], 50)
    assert len(written) == 1 and [(r.step, r.source, r.gain) for r in picks.collect()] == [(1, "a", 3)]
    assert coverage.count() == 50 and coverage.where("covered = 1.0").count() == 50


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_of_odd_vectors_match_brute_force(spark, kind):
    """many chunks and cells; ids repeat, vectors are equal, null, zero or no numbers. These come last and hide nobody else."""
    rng = np.random.default_rng(6)
    vectors = np.round(rng.normal(size=(260, 5)), 1).astype(np.float32)
    vectors[200:230] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(i, vectors[i].tolist()) for i in (5, 6, 7, 8)]
    rows += [(300, [0.0] * 5), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    bad = spark.createDataFrame([(999, [float("nan")] * 5)], f"vec_id long, embedding array<{kind}>")
    test, train = df.where("vec_id % 4 = 0"), df.where("vec_id % 4 <> 0 OR vec_id IS NULL")
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    ids = [r[0] for r in rows if r[0] < 260 and r[0] % 4]
    for members in (train, train.unionByName(bad)):
        found = K.nearest_neighbours(test, members, 9, block_rows=16, pivots=6)
        got = {}
        for r in found.orderBy("test_id", "rank").collect():
            got.setdefault(r.test_id, []).append((r.train_id, r.similarity))
        assert sorted(got) == list(range(0, 260, 4))
        for q in got:
            best = sorted(((i, s) for i, s in zip(ids, np.round(unit[ids] @ unit[q], 9), strict=True)), key=lambda p: (-p[1], p[0]))
            best = sorted(best * (1 + (q == 8)), key=lambda p: (-p[1], p[0]))[:9]  # this query is there twice
            assert [b for _, b in got[q]] == pytest.approx([b for _, b in best], abs=2e-9) and [a for a, _ in got[q]] == [a for a, _ in best]


def test_a_member_is_sent_once_a_chunk_and_no_pair_but_the_best_is_written(spark, monkeypatch):
    """queries were sent once a block of members, members once a chunk of queries, and every block wrote its best k. F2: shuffles end with their query."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))], "vec_id long, embedding array<float>")
    test, train = df.where("vec_id % 4 = 0"), df.where("vec_id % 4 <> 0")
    streams, search = [], K._searched

    def counted(queries, members, wanted, chunks, *rest):
        sent_ = members.join(wanted, "cell").select(F.explode("chunks").alias("chunk"), "n", "cell")
        streams.append((chunks, queries.agg(F.sum(F.length("ids") / 8)).first()[0], {r.chunk: r.n for r in sent_.groupBy("chunk").agg(F.sum("n").alias("n")).collect()}))
        out = search(queries, members, wanted, chunks, *rest)
        streams[-1] += (out,)
        return out

    monkeypatch.setattr(K, "_searched", counted)
    monkeypatch.setattr(K, "CHUNK_ROWS", 30)
    K.nearest_neighbours(test, train, 5, block_rows=40, pivots=4).count()
    (chunks, asked, first, _), (_, again, rest, last) = streams
    assert chunks == 4 and asked == again == 100 and last.count() == 100 * 5
    assert all(first.get(c, 0) + rest.get(c, 0) <= 300 for c in range(chunks))


def test_votes_of_a_row_travel_together(spark):
    """a row per neighbour and model was moved. Votes come twice or are missing, a model has no name."""
    near = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 10, 0.7, 1), (3, 12, 0.7, 1), (4, 99, 0.1, 1)], "test_id long, train_id long, similarity double, rank int")
    votes = [(10, "a", 1), (10, "a", 0), (10, "b", 1), (11, "a", 1), (11, "b", None), (11, None, 1), (12, "b", None), (13, "c", 1)]
    correct = spark.createDataFrame(votes, "sample_id long, model string, correct int")
    scores = K.neighbour_scores(near, correct)
    assert {(r.test_id, r.model): r.logit for r in scores.collect()} == {(1, "a"): pytest.approx(2 / 3), (1, "b"): 1.0, (1, None): 1.0, (2, "a"): 0.5, (2, "b"): 1.0}
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "test_id" in x and "code" in x]
