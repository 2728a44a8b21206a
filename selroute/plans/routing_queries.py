"""Transfer matrices, neighbours, routing policies and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from selroute.operators import neighbours as K
from selroute.operators import routing as R
from selroute.operators import selection as G
from selroute.operators import transfer as X
from selroute.operators.calibration import calibrated_scores
from selroute.operators.fits import score_networks
from selroute.operators.learn import train_networks
from selroute.operators.reshape import to_wide
from selroute.plans.registry import query, r6, rounded
from selroute.plans.views import MODELS

# --- transfer matrix ---------------------------------------------------------------------------------


def _transfer(v):
    return X.transfer_metrics(v.scores, v.truth, ["row_id"]).select("source", "target", "auroc")


def _holed(v):
    return _transfer(v).where(
        "NOT (source = 'model_1' AND target = 'model_3') AND NOT (source = 'model_4' AND target = 'model_0')"
    )


def _filled(v):
    return X.fill_missing(_holed(v))


_PAIR_BUNDLE = """SELECT {k} source, target, round((sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0), 6) AS auroc,
    round(avg((p - label) ** 2), 6) AS brier, round(avg(CAST(CAST(p >= 0.5 AS INT) = label AS INT)), 6) AS accuracy,
    CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg FROM rk GROUP BY ALL"""
_RK = """rk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY p) + (count(*) OVER (PARTITION BY {k}, p) - 1) / 2.0 AS rk
    FROM (SELECT *, 1 / (1 + exp(-logit)) AS p FROM {t}))"""


@query("c6_aligned_rows", "SELECT source, target, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM transfer_pairs GROUP BY ALL")
def _(v):
    pairs = X.aligned(v.scores, v.truth, ["row_id"])
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"))


@query("c7_source_target_pairs", "SELECT source, target, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, round(avg(logit), 6) AS mean_logit FROM transfer_pairs GROUP BY ALL")
def _(v):
    return rounded(X.pair_means(v.scores, v.truth, ["row_id"]), "mean_logit")


@query("q19_misaligned_rows", "SELECT row_id, model AS source FROM eval_long WHERE row_id NOT IN (SELECT doc_id FROM labels)")
def _(v):
    scores = v.scores.select("row_id", "source")
    return X.misaligned_rows(scores, v.table("labels").select(F.col("doc_id").alias("row_id")), ["row_id"])


def _pair_sql(keys: str, table: str) -> str:
    """The bundle with average precision for every (keys) group of score and label pairs."""
    return f"""WITH {_RK.format(k=keys, t=table)}, b AS ({_PAIR_BUNDLE.format(k=keys.removesuffix('source, target'))}),
    c AS (SELECT {keys}, p, sum(label) AS pos, count(*) AS n FROM rk GROUP BY ALL),
    s AS (SELECT {keys}, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY {keys}) AS np
      FROM c WINDOW w AS (PARTITION BY {keys} ORDER BY p DESC)),
    ap AS (SELECT {keys}, round(sum(pos / np * tp / seen), 6) AS aupr FROM s GROUP BY ALL)
    SELECT b.*, CASE WHEN n_pos > 0 AND n_neg > 0 THEN aupr END AS aupr FROM b JOIN ap USING ({keys})"""


@query("k1_transfer_bundle", _pair_sql("source, target", "transfer_pairs"))
def _(v):
    return rounded(X.transfer_metrics(v.scores, v.truth, ["row_id"]), "auroc", "aupr", "brier", "accuracy")


@query("k1_transfer_distinct_scores", _pair_sql("source, target", "distinct_pairs"))
def _(v):
    """The same with a score of its own for every row, so that no two rows combine."""
    return rounded(X.transfer_metrics(v.distinct_scores, v.truth, ["row_id"]), "auroc", "aupr", "brier", "accuracy")


@query("k2_bank_matrix", _pair_sql("run, source, target", "bank_pairs"))
def _(v):
    return rounded(v.routing.bank_matrix, "auroc", "aupr", "brier", "accuracy")


@query("b16_median_fill", "SELECT source, target, round(auroc, 6) AS auroc FROM filled")
def _(v):
    return rounded(_filled(v), "auroc")


@query(
    "b16_median_fill_by_source",
    """SELECT s.source, t.target, round(coalesce(h.auroc, m.med), 6) AS auroc FROM (SELECT DISTINCT source FROM holed) s,
      (SELECT DISTINCT target FROM holed) t LEFT JOIN holed h ON h.source = s.source AND h.target = t.target
      LEFT JOIN (SELECT source, quantile_cont(auroc, 0.5) AS med FROM holed GROUP BY 1) m ON m.source = s.source""",
)
def _(v):
    return rounded(X.fill_missing(_holed(v), impute="source"), "auroc")


@query("d12_row_median", "SELECT source, round(quantile_cont(auroc, 0.5), 6) AS median FROM transfer GROUP BY 1")
def _(v):
    return _transfer(v).groupBy("source").agg(r6(F.median("auroc")).alias("median"))  # one value per model and row


_SUMMARY = """src AS (SELECT source AS name, avg(auroc) AS mean_as_source, max(auroc) AS best_target_value FROM filled GROUP BY 1),
    tgt AS (SELECT target AS name, avg(auroc) AS mean_as_target, max(auroc) AS best_source_value FROM filled GROUP BY 1),
    bt AS (SELECT * FROM (SELECT source AS name, target AS best_target_name, row_number() OVER (PARTITION BY source ORDER BY auroc DESC, target) AS r FROM filled) WHERE r = 1),
    bs AS (SELECT * FROM (SELECT target AS name, source AS best_source_name, row_number() OVER (PARTITION BY target ORDER BY auroc DESC, source) AS r FROM filled) WHERE r = 1),
    own AS (SELECT source AS name, auroc AS in_domain FROM filled WHERE source = target)"""


@query("d11_matrix_extremes", f"WITH {_SUMMARY} SELECT name, best_target_name, round(best_target_value, 6) AS best_target_value, round(mean_as_target, 6) AS mean_as_target FROM src JOIN tgt USING (name) JOIN bt USING (name)")
def _(v):
    return rounded(X.transfer_summary(_filled(v)).select("name", "best_target_name", "best_target_value", "mean_as_target"), "best_target_value", "mean_as_target")


@query(
    "k3_transfer_summary",
    f"""WITH {_SUMMARY} SELECT name, round(mean_as_source, 6) AS mean_as_source, round(mean_as_target, 6) AS mean_as_target, best_target_name,
    round(best_target_value, 6) AS best_target_value, best_source_name, round(best_source_value, 6) AS best_source_value, round(in_domain, 6) AS in_domain_performance,
    round(in_domain - best_target_value, 6) AS diff_in_domain_minus_best_target, round(in_domain - mean_as_source, 6) AS diff_in_domain_minus_mean_as_source
    FROM src JOIN tgt USING (name) JOIN bt USING (name) JOIN bs USING (name) JOIN own USING (name)""",
)
def _(v):
    out = X.transfer_summary(_filled(v))
    return rounded(out, *[f.name for f in out.schema.fields if f.dataType.simpleString() == "double"]).orderBy("mean_as_source")


@query("k4_best_target_frequency", f"WITH {_SUMMARY} SELECT best_target_name, count(*) AS n FROM bt GROUP BY 1")
def _(v):
    return X.transfer_summary(_filled(v)).groupBy("best_target_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k5_profile_distances",
    """SELECT a.source AS source_a, b.source AS source_b, round(avg(abs(a.auroc - b.auroc)), 6) AS distance FROM filled a JOIN filled b
      ON a.target = b.target AND a.source < b.source GROUP BY ALL""",
)
def _(v):
    return rounded(X.profile_distances(_filled(v)), "distance")


@query("k6_matrix_range", "SELECT round(min(auroc), 6) AS lowest, round(max(auroc), 6) AS highest FROM filled")
def _(v):
    return _filled(v).agg(r6(F.min("auroc")).alias("lowest"), r6(F.max("auroc")).alias("highest"))


@query(
    "k6_reordered_matrix",
    """WITH o AS (SELECT source AS model, CAST(row_number() OVER (ORDER BY avg(auroc), source) - 1 AS INT) AS position FROM filled GROUP BY 1)
    SELECT source, target, a.position AS source_position, b.position AS target_position, round(auroc, 6) AS auroc
    FROM filled JOIN o a ON a.model = source JOIN o b ON b.model = target""",
)
def _(v):
    filled = _filled(v)
    means = filled.groupBy(F.col("source").alias("model")).agg(F.avg("auroc").alias("mean"))  # one row per model
    order = means.select("model", F.expr("CAST(row_number() OVER (ORDER BY mean, model) - 1 AS INT)").alias("position"))
    return rounded(X.reordered(filled, order), "auroc")


@query("b13_matrix_pivot", "SELECT source, " + ", ".join(f"round(max(auroc) FILTER (target = '{m}'), 6) AS {m}" for m in MODELS) + " FROM transfer GROUP BY 1")
def _(v):
    return rounded(to_wide(_transfer(v), ["source"], "target", "auroc", MODELS), *MODELS)


# --- routing core ------------------------------------------------------------------------------------

_ROUTE = "raw AS (SELECT run, sample_id, model FROM (SELECT *, row_number() OVER (PARTITION BY run, sample_id ORDER BY logit DESC, model) AS r FROM test_scores) WHERE r = 1)"
_ACC = "SELECT run, round(CASE WHEN count(correct) = count(*) THEN avg(CAST(correct AS DOUBLE)) END, 6) AS accuracy FROM {t} LEFT JOIN test_correct USING (sample_id, model) GROUP BY 1"
_ACC0 = "SELECT run, round(avg(CAST(coalesce(correct, 0) AS DOUBLE)), 6) AS accuracy FROM {t} LEFT JOIN test_correct USING (sample_id, model) GROUP BY 1"


def _raw(v):
    return R.best_scored(v.routing.test_scores, ["run", "sample_id"])


@query("f2_top_model", "SELECT row_id, model FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY logit DESC, model) AS r FROM eval_long) WHERE r = 1")
def _(v):
    return R.best_scored(v.eval_long, ["row_id"])


@query("m1_raw_router", f"WITH {_ROUTE} SELECT * FROM raw")
def _(v):
    return _raw(v)


@query("c10_chosen_cells", f"WITH {_ROUTE} SELECT run, sample_id, model, correct FROM raw LEFT JOIN test_correct USING (sample_id, model)")
def _(v):
    return _raw(v).join(v.routing.test_correct, ["sample_id", "model"], "left")


@query("m2_accuracy_missing_zero", f"WITH {_ROUTE} {_ACC0.format(t='raw')}")
def _(v):
    return rounded(R.chosen_accuracy(_raw(v), v.routing.test_correct, ["sample_id"], ["run"], missing="zero"), "accuracy")


@query("m2_accuracy_missing_null", f"WITH {_ROUTE} {_ACC.format(t='raw')}")
def _(v):
    return rounded(R.chosen_accuracy(_raw(v), v.routing.test_correct, ["sample_id"], ["run"], missing="null"), "accuracy")


@query("d14_route_counts", f"WITH {_ROUTE} SELECT run, model, count(*) AS n FROM raw GROUP BY ALL")
def _(v):
    return _raw(v).groupBy("run", "model").agg(F.count(F.lit(1)).alias("n"))


@query("d9_model_means", "SELECT model, round(avg(correct), 6) AS accuracy FROM test_correct GROUP BY 1")
def _(v):
    return rounded(R.best_single_model(v.routing.test_correct), "accuracy")


@query("d10_oracle_accuracy", "SELECT round(avg(b), 6) AS accuracy FROM (SELECT max(correct) AS b FROM test_correct GROUP BY sample_id)")
def _(v):
    return rounded(R.oracle_accuracy(v.routing.test_correct, ["sample_id"]), "accuracy")


_BOUNDS = """bounds AS (SELECT 'best model' AS strategy, (SELECT avg(correct) AS a FROM test_correct GROUP BY model ORDER BY a DESC LIMIT 1) AS accuracy
    UNION ALL SELECT 'oracle', (SELECT avg(b) FROM (SELECT max(correct) AS b FROM test_correct GROUP BY sample_id)))"""


def _bounds(v):
    best = R.best_single_model(v.routing.test_correct).limit(1).select(F.lit("best model").alias("strategy"), "accuracy")
    oracle = R.oracle_accuracy(v.routing.test_correct, ["sample_id"]).select(F.lit("oracle").alias("strategy"), "accuracy")
    return best.unionByName(oracle)


@query("m11_bounds", f"WITH {_BOUNDS} SELECT strategy, round(accuracy, 6) AS accuracy FROM bounds")
def _(v):
    return rounded(_bounds(v), "accuracy")


# --- knee --------------------------------------------------------------------------------------------

# The walk over the difference curve, spelled out with self joins instead of running windows.
_KNEE = f"""{_ROUTE}, usage AS (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY n DESC, model) - 1 AS INT) AS position
      FROM (SELECT run, model, count(*) AS n FROM raw GROUP BY ALL)),
    ext AS (SELECT run, max(n) AS hi, min(n) AS lo, count(*) AS pts FROM usage GROUP BY 1),
    df AS (SELECT u.run, u.position AS i, pts, round((hi - n) / nullif(CAST(hi - lo AS DOUBLE), 0) - u.position / nullif(CAST(pts - 1 AS DOUBLE), 0), 12) AS d FROM usage u JOIN ext USING (run)),
    nb AS (SELECT c.*, coalesce(b.d, c.d) AS db, coalesce(a.d, c.d) AS da, a.d AS nxt FROM df c LEFT JOIN df b ON b.run = c.run AND b.i = c.i - 1 LEFT JOIN df a ON a.run = c.run AND a.i = c.i + 1),
    ev AS (SELECT *, d >= db AND d >= da AS mx, d <= db AND d <= da AS mn, d - 1.0 / (pts - 1) AS t FROM nb),
    st AS (SELECT e.run, e.i, e.nxt, (SELECT max(p.i) FROM ev p WHERE p.run = e.run AND p.i <= e.i AND p.mx) AS peak,
      (SELECT max(p.i) FROM ev p WHERE p.run = e.run AND p.i <= e.i AND (p.mx OR p.mn)) AS lastev FROM ev e),
    hit AS (SELECT st.run, min(st.i) AS i FROM st JOIN ev ON ev.run = st.run AND ev.i = st.lastev WHERE peak IS NOT NULL AND st.nxt < CASE WHEN ev.mn THEN 0.0 ELSE ev.t END GROUP BY 1),
    knees AS (SELECT ext.run, st.peak AS knee, pts AS n_models FROM ext LEFT JOIN hit ON hit.run = ext.run LEFT JOIN st ON st.run = hit.run AND st.i = hit.i),
    kept AS (SELECT u.run, u.model, u.position AS pick_order FROM usage u JOIN knees k USING (run) WHERE coalesce(k.knee, 0) = 0 OR u.position < k.knee),
    elbow AS (SELECT run, sample_id, model FROM (SELECT s.*, row_number() OVER (PARTITION BY s.run, sample_id ORDER BY logit DESC, pick_order) AS r
      FROM test_scores s JOIN kept k ON k.run = s.run AND k.model = s.model) WHERE r = 1)"""


@query("m5_knee", f"WITH {_KNEE} SELECT run, knee, n_models FROM knees")
def _(v):
    return G.knee_points(G.usage_curve(_raw(v), ["run"]), ["run"])


@query("m4_elbow_router", f"WITH {_KNEE} SELECT * FROM elbow")
def _(v):
    return R.elbow_routes(v.routing.test_scores, ["sample_id"], ["run"])


# --- greedy coverage ---------------------------------------------------------------------------------


def _greedy_sql(cells: str, group: str, rounds: int) -> str:
    """Unrolled greedy cover over ``cells(group, source, target)`` in ``universe(group, target)``."""
    g = [c.strip() for c in group.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in g)
    parts = [f"open1 AS (SELECT {group}, target FROM universe)"]
    for k in range(1, rounds + 1):
        parts.append(
            f"""pick{k} AS (SELECT * FROM (SELECT {', '.join('c.' + c for c in g)}, {k} AS step, c.source, count(*) AS gain,
            row_number() OVER (PARTITION BY {', '.join('c.' + c for c in g)} ORDER BY count(*) DESC, c.source) AS r
            FROM {cells} c JOIN open{k} o ON {on('c', 'o')} AND c.target = o.target GROUP BY {', '.join('c.' + c for c in g)}, c.source) WHERE r = 1)"""
        )
        parts.append(
            f"""open{k + 1} AS (SELECT o.* FROM open{k} o ANTI JOIN (SELECT {', '.join('c.' + c for c in g)}, c.target FROM {cells} c JOIN pick{k} p
            ON {on('c', 'p')} AND c.source = p.source) x ON {on('o', 'x')} AND o.target = x.target)"""
        )
    union = " UNION ALL ".join(f"SELECT {group}, step, source, gain FROM pick{k}" for k in range(1, rounds + 1))
    parts.append(f"picks AS ({union})")
    return ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)


_BFILL = """bfill AS (SELECT g.run, g.source, t.target, coalesce(b.auroc, m.med) AS auroc FROM (SELECT DISTINCT run, source FROM bank_matrix) g
    JOIN (SELECT DISTINCT run, target FROM bank_matrix) t USING (run) LEFT JOIN bank_matrix b ON b.run = g.run AND b.source = g.source AND b.target = t.target
    LEFT JOIN (SELECT run, source, quantile_cont(auroc, 0.5) AS med FROM bank_matrix GROUP BY ALL) m ON m.run = g.run AND m.source = t.target)"""
_ONE_TAU = f"""{_BFILL}, cells AS (SELECT run, source, target FROM bfill WHERE auroc >= 0.6), universe AS (SELECT DISTINCT run, target FROM bfill),
    {_greedy_sql('cells', 'run', 10)}"""


def _bank_greedy(v):
    return R.coverage_picks(v.routing.bank_matrix.select("run", "source", "target", "auroc"), ["run"], 0.6, len(MODELS))


@query("m6_greedy_picks", f"WITH {_ONE_TAU} SELECT * FROM picks")
def _(v):
    return _bank_greedy(v)[0]


@query(
    "m6_coverage_fractions",
    f"""WITH {_ONE_TAU} SELECT u.run, CAST(s.step AS INT) AS step, round(coalesce((SELECT sum(gain) FROM picks p WHERE p.run = u.run AND p.step <= s.step), 0) / u.n, 6) AS covered
    FROM (SELECT run, count(*) AS n FROM universe GROUP BY 1) u, range(1, 11) s(step)""",
)
def _(v):
    return rounded(_bank_greedy(v)[1], "covered")


@query(
    "m7_coverage_router",
    f"""WITH {_ONE_TAU} SELECT run, sample_id, model FROM (SELECT s.run, s.sample_id, s.model, row_number() OVER (PARTITION BY s.run, s.sample_id ORDER BY logit DESC, p.step) AS r
      FROM test_scores s JOIN picks p ON p.run = s.run AND p.source = s.model) WHERE r = 1""",
)
def _(v):
    picks, _coverage = _bank_greedy(v)
    return R.coverage_routes(v.routing.test_scores, picks, ["sample_id"], ["run"])


_TAUS = f"""{_BFILL}, taus AS (SELECT i / 100.0::DOUBLE AS tau FROM range(1, 101) t(i)),
    cells AS (SELECT run, tau, source, target FROM bfill, taus WHERE auroc >= tau), universe AS (SELECT DISTINCT run, tau, target FROM bfill, taus),
    {_greedy_sql('cells', 'run, tau', 10)},
    troute AS (SELECT * FROM (SELECT s.run, p.tau, s.sample_id, s.model, row_number() OVER (PARTITION BY s.run, p.tau, s.sample_id ORDER BY logit DESC, p.step) AS r
      FROM bank_scores s JOIN picks p ON p.run = s.run AND p.source = s.model) WHERE r = 1),
    tacc AS (SELECT run, tau, CASE WHEN count(correct) = count(*) THEN avg(CAST(correct AS DOUBLE)) END AS accuracy FROM troute LEFT JOIN bank_correct USING (sample_id, model) GROUP BY ALL),
    search AS (SELECT run, tau, coalesce(accuracy, 0.0) AS accuracy FROM (SELECT DISTINCT run, tau FROM universe) LEFT JOIN tacc USING (run, tau)),
    best AS (SELECT run, tau FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, tau) AS r FROM search) WHERE r = 1)"""


def _search(v):
    data = v.routing
    matrix = data.bank_matrix.select("run", "source", "target", "auroc")
    return R.tau_search(matrix, data.bank_scores, data.bank_correct, ["sample_id"], ["run"])


@query("m8_tau_search", f"WITH {_TAUS} SELECT run, tau, round(accuracy, 6) AS accuracy FROM search")
def _(v):
    return rounded(_search(v), "accuracy")


@query("m8_best_tau", f"WITH {_TAUS} SELECT * FROM best")
def _(v):
    return R.best_tau(_search(v), ["run"])


# --- calibration -------------------------------------------------------------------------------------

# Isotonic regression by the max-min formula over pooled scores, then linear interpolation with clipping.
_CALIBRATED = """pooled AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY x) AS i FROM (SELECT s.run || ':' || s.model AS model, s.logit AS x,
      avg(CAST(c.correct AS DOUBLE)) AS y, count(*) AS w FROM bank_scores s JOIN bank_correct c USING (sample_id, model)
      WHERE c.correct IS NOT NULL GROUP BY ALL)),
    cum AS (SELECT *, sum(y * w) OVER o AS sy, sum(w) OVER o AS sw FROM pooled WINDOW o AS (PARTITION BY model ORDER BY i)),
    seg AS (SELECT a.model, a.i AS lo, b.i AS hi, (b.sy - a.sy + a.y * a.w) / (b.sw - a.sw + a.w) AS m FROM cum a JOIN cum b ON b.model = a.model AND b.i >= a.i),
    mins AS (SELECT p.model, p.i, s.lo, min(s.m) AS m FROM pooled p JOIN seg s ON s.model = p.model AND s.lo <= p.i AND s.hi >= p.i GROUP BY ALL),
    iso AS (SELECT p.model, p.x, max(m.m) AS f FROM pooled p JOIN mins m USING (model, i) GROUP BY ALL),
    near AS (SELECT t.run, t.sample_id, t.model, t.logit, max(i.x) FILTER (i.x <= t.logit) AS x0, min(i.x) FILTER (i.x >= t.logit) AS x1
      FROM test_scores t LEFT JOIN iso i ON i.model = t.run || ':' || t.model GROUP BY ALL),
    cal AS (SELECT n.run, n.sample_id, n.model, round(CASE WHEN x0 IS NULL THEN b.f WHEN x1 IS NULL OR x0 = x1 THEN a.f ELSE a.f + (b.f - a.f) * (n.logit - x0) / (x1 - x0) END, 9) AS logit
      FROM near n LEFT JOIN iso a ON a.model = n.run || ':' || n.model AND a.x = n.x0 LEFT JOIN iso b ON b.model = n.run || ':' || n.model AND b.x = n.x1)"""


def _calibrated(v):
    data = v.routing
    bank = data.bank_scores.join(data.bank_correct, ["sample_id", "model"])
    return calibrated_scores(data.test_scores, bank, ["run", "model"]).withColumn("logit", F.round("logit", 9))


@query("l9_isotonic_calibration", f"WITH {_CALIBRATED} SELECT run, sample_id, model, round(logit, 6) AS score FROM cal")
def _(v):
    return _calibrated(v).select("run", "sample_id", "model", r6("logit").alias("score"))


@query(
    "m3_calibrated_router",
    f"WITH {_CALIBRATED} SELECT run, sample_id, model FROM (SELECT *, row_number() OVER (PARTITION BY run, sample_id ORDER BY logit DESC, model) AS r FROM cal) WHERE r = 1",
)
def _(v):
    return R.best_scored(_calibrated(v), ["run", "sample_id"])


# --- neighbours --------------------------------------------------------------------------------------


def _neighbours(v, k=40):
    data = v.embedded.select("vec_id", "embedding", "part")
    return K.nearest_neighbours(data.where("part = 'test'"), data.where("part = 'train'"), k)


@query("c9_nearest_neighbours", "SELECT test_id, train_id, similarity, CAST(rank AS INT) AS rank FROM knn")
def _(v):
    return _neighbours(v)


_KNN_ROUTE = """votes AS (SELECT test_id AS sample_id, model, avg(CAST(correct AS DOUBLE)) AS logit FROM knn JOIN embedded_correct ON sample_id = train_id GROUP BY ALL),
    kroute AS (SELECT sample_id, model FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(logit, 9) DESC, model) AS r FROM votes) WHERE r = 1)"""


def _knn_routes(v):
    votes = K.neighbour_scores(_neighbours(v), v.embedded_correct).withColumn("logit", F.round("logit", 9))
    return R.best_scored(votes.withColumnRenamed("test_id", "sample_id"), ["sample_id"])


@query("m9_neighbour_router", f"WITH {_KNN_ROUTE} SELECT * FROM kroute")
def _(v):
    return _knn_routes(v)


@query("m9_neighbour_accuracy", f"WITH {_KNN_ROUTE} SELECT round(avg(coalesce(correct, 0)), 6) AS accuracy FROM kroute LEFT JOIN embedded_correct USING (sample_id, model)")
def _(v):
    return rounded(R.chosen_accuracy(_knn_routes(v), v.embedded_correct, ["sample_id"], missing="zero"), "accuracy")


# --- all strategies ----------------------------------------------------------------------------------

_ALL = f"""{_KNEE}, {_TAUS}, {_CALIBRATED},
    final_picks AS (SELECT p.run, p.source, p.step FROM picks p JOIN best b ON b.run = p.run AND b.tau = p.tau),
    croute AS (SELECT run, sample_id, model FROM (SELECT s.run, s.sample_id, s.model, row_number() OVER (PARTITION BY s.run, s.sample_id ORDER BY logit DESC, p.step) AS r
      FROM test_scores s JOIN final_picks p ON p.run = s.run AND p.source = s.model) WHERE r = 1),
    routed AS (SELECT 'raw' AS strategy, run, sample_id, model FROM raw UNION ALL SELECT 'elbow-pruning', run, sample_id, model FROM elbow
      UNION ALL SELECT 'coverage-pruning', run, sample_id, model FROM croute
      UNION ALL SELECT 'calibrated', run, sample_id, model FROM (
        SELECT *, row_number() OVER (PARTITION BY run, sample_id ORDER BY logit DESC, model) AS r FROM cal) WHERE r = 1),
    accs AS (SELECT strategy, run, avg(CAST(coalesce(correct, 0) AS DOUBLE)) AS accuracy FROM routed LEFT JOIN test_correct USING (sample_id, model) GROUP BY ALL),
    {_BOUNDS}, pvotes AS (SELECT test_id AS sample_id, model, round(avg(CAST(correct AS DOUBLE)), 9) AS logit FROM prompt_knn JOIN correct ON sample_id = train_id GROUP BY ALL),
    proute AS (SELECT sample_id, model FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY logit DESC, model) AS r FROM pvotes WHERE logit IS NOT NULL) WHERE r = 1),
    everything AS (SELECT strategy, accuracy FROM accs UNION ALL FROM bounds UNION ALL
      SELECT 'knn', avg(CAST(coalesce(correct, 0) AS DOUBLE)) FROM proute LEFT JOIN test_correct USING (sample_id, model))"""


def _all_routes(v):
    from selroute.session import durable

    data = v.routing
    matrix = durable(data.bank_matrix.select("run", "source", "target", "auroc"))
    search = R.tau_search(matrix, data.bank_scores, data.bank_correct, ["sample_id"], ["run"])
    picks, _coverage = R.coverage_picks(matrix, ["run"], R.best_tau(search, ["run"]), len(MODELS))
    named = {
        "raw": _raw(v),
        "elbow-pruning": R.elbow_routes(data.test_scores, ["sample_id"], ["run"]),
        "coverage-pruning": R.coverage_routes(data.test_scores, picks, ["sample_id"], ["run"]),
        "calibrated": R.best_scored(_calibrated(v), ["run", "sample_id"]),
    }
    out = None
    for strategy, routes in named.items():
        part = routes.select(F.lit(strategy).alias("strategy"), "run", "sample_id", "model")
        out = part if out is None else out.unionByName(part)
    return out


def _vectors_of(v, ids):
    return v.prompt_vectors.join(ids.withColumnRenamed("sample_id", "vec_id"), "vec_id")


def _rated(v, routes, strategy):
    accuracy = R.chosen_accuracy(routes, v.routing.test_correct, ["sample_id"], missing="zero")
    return accuracy.select(F.lit(strategy).alias("strategy"), "accuracy")


def _knn_strategy(v):
    """Neighbours among the training prompts vote for the models that answered them."""
    data = v.routing
    found = K.nearest_neighbours(_vectors_of(v, data.test_ids), _vectors_of(v, data.train_ids), 40)
    votes = K.neighbour_scores(found, v.correct).withColumn("logit", F.round("logit", 9)).withColumnRenamed("test_id", "sample_id")
    return _rated(v, R.best_scored(votes, ["sample_id"]), "knn")


def _network_strategy(v, hidden, max_steps):
    """A network per model on the vectors of the training prompts; the most confident model answers."""
    data = v.routing
    labels = v.correct.join(data.train_ids, "sample_id", "left_semi").withColumnRenamed("sample_id", "vec_id")
    networks = train_networks(_vectors_of(v, data.train_ids).join(labels, "vec_id"), MODELS, seed=0, hidden=hidden, max_steps=max_steps)
    scores = score_networks(_vectors_of(v, data.test_ids), networks, MODELS, ["vec_id"]).withColumnRenamed("vec_id", "sample_id")
    return _rated(v, R.best_scored(scores, ["sample_id"]), "mlp_" + "_".join(map(str, hidden)))


def _all_strategies(v):
    per_run = R.chosen_accuracy(_all_routes(v), v.routing.test_correct, ["sample_id"], ["strategy", "run"], missing="zero")
    return per_run.select("strategy", "accuracy").unionByName(_bounds(v)).unionByName(_knn_strategy(v))


@query("m12_strategy_summary", f"WITH {_ALL} SELECT strategy, round(avg(accuracy), 6) AS mean_accuracy FROM everything GROUP BY 1")
def _(v):
    return rounded(R.strategy_summary(_all_strategies(v)), "mean_accuracy")


@query("m12_nine_strategies")
def _(v):
    """The same table with both networks, whose fitted values SQL can't state."""
    networks = _network_strategy(v, (1,), 1000).unionByName(_network_strategy(v, (100, 100), 1000))
    return rounded(R.strategy_summary(_all_strategies(v).unionByName(networks)), "mean_accuracy")


@query("d13_mean_by_group", f"WITH {_ROUTE}, a AS ({_ACC0.format(t='raw')}) SELECT run % 2 AS layers, round(avg(accuracy), 6) AS mean_accuracy FROM a GROUP BY 1")
def _(v):
    acc = rounded(R.chosen_accuracy(_raw(v), v.routing.test_correct, ["sample_id"], ["run"], missing="zero"), "accuracy")
    return acc.groupBy((F.col("run") % 2).alias("layers")).agg(r6(F.avg("accuracy")).alias("mean_accuracy"))


@query("d15_summary_of_routers", f"WITH {_KNEE}, u AS (SELECT 'raw' AS strategy, run, sample_id, model FROM raw UNION ALL SELECT 'elbow', run, sample_id, model FROM elbow), a AS (SELECT strategy, run, avg(CAST(coalesce(correct, 0) AS DOUBLE)) AS accuracy FROM u LEFT JOIN test_correct USING (sample_id, model) GROUP BY ALL) SELECT strategy, round(avg(accuracy), 6) AS mean_accuracy FROM a GROUP BY 1")
def _(v):
    raw = _raw(v).select(F.lit("raw").alias("strategy"), "run", "sample_id", "model")
    elbow = R.elbow_routes(v.routing.test_scores, ["sample_id"], ["run"]).select(F.lit("elbow").alias("strategy"), "run", "sample_id", "model")
    acc = R.chosen_accuracy(raw.unionByName(elbow), v.routing.test_correct, ["sample_id"], ["strategy", "run"], missing="zero")
    return rounded(R.strategy_summary(acc), "mean_accuracy")


@query("a10_route_bundle", f"WITH {_ROUTE} SELECT 'raw' AS strategy, run, count(*) AS n, count(DISTINCT model) AS n_models FROM raw GROUP BY ALL")
def _(v):
    from selroute.session import scratch_path
    from selroute.sources.tables import read_routes, write_routes

    root = scratch_path(v.spark, "bundle")
    routes = _raw(v).withColumn("strategy", F.lit("raw"))
    metrics = R.chosen_accuracy(_raw(v), v.routing.test_correct, ["sample_id"], ["run"], missing="zero")
    write_routes(routes, metrics, root)
    stored, accuracies = read_routes(v.spark, root)
    counted = stored.groupBy("strategy", "run").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("model").alias("n_models"))
    return counted.join(accuracies, "run").drop("accuracy")
