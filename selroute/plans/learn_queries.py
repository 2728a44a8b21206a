"""Training and batch inference.

Fitted values are not SQL. The queries return what SQL can state about them: which rows are scored by which model, with which
label and class counts, and that a fit is at its optimum (the errors on its training rows add up to nothing). Scores themselves are
checked in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from selroute.functions.scores import sigmoid
from selroute.operators import fits as B
from selroute.operators import learn as T
from selroute.operators import routing as R
from selroute.operators import transfer as X
from selroute.operators.labels import BLEU_GRID, F1_GRID, rule_name
from selroute.operators.metrics import eval_metrics
from selroute.operators.splits import bank_split
from selroute.plans.registry import query
from selroute.plans.views import MODELS
from selroute.session import durable


def _prompts(v):
    return v.table("documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("prompt"))


def _labelled(v):
    return v.eval_long.select("row_id", "model", "correct").join(_prompts(v).select("row_id"), "row_id")


_SHARE = f"({T.TEST_ROWS}::DOUBLE / {T.TRAIN_ROWS + T.TEST_ROWS})"
RUNS, EPOCHS = 10, (3, 6, 10)


def _drawn(runs: int) -> str:
    """Test rows of every model's rejector for every run."""
    return f"""WITH drawn AS (SELECT model, CAST(run AS INT) AS run, row_id, correct, row_number() OVER (PARTITION BY model, run ORDER BY md5((42 + run) || '-' || row_id), row_id) AS r,
      count(*) OVER (PARTITION BY model, run) AS n FROM eval_long, range({runs}) q(run) WHERE correct IS NOT NULL),
    tested AS (SELECT * FROM drawn WHERE r <= ceil(n * {_SHARE}))"""


@query("l1_rejector_predictions", f"{_drawn(RUNS)} SELECT model, run, 10 AS epoch, row_id, correct AS label, true AS scored FROM tested")
def _(v):
    stored = T.run_rejectors(_labelled(v), MODELS, runs=RUNS, epochs=(10,), train_rows=None, prompts=_prompts(v))
    return stored.select("model", "run", "epoch", "row_id", "label", F.col("logit").isNotNull().alias("scored"))


@query(
    "l5_epoch_metrics",
    f"""{_drawn(RUNS)} SELECT model, run, epoch, CAST(sum(correct) AS BIGINT) AS n_pos, CAST(sum(1 - correct) AS BIGINT) AS n_neg, true AS rated
    FROM tested, (VALUES {", ".join(f"({e})" for e in EPOCHS)}) e(epoch) GROUP BY ALL""",
)
def _(v):
    stored = T.run_rejectors(_labelled(v), MODELS, runs=RUNS, epochs=EPOCHS, train_rows=None, prompts=_prompts(v))
    bundle = eval_metrics(stored, ["model", "run", "epoch"])
    return bundle.select("model", "run", "epoch", "n_pos", "n_neg", F.col("auroc").between(0, 1).alias("rated"))


def _routed_training(v):
    """Words of all prompts, bank held out, one rejector per model: (words table, bank ids, training labels, rejectors)."""
    words = durable(B.hashed_words(_prompts(v), ["row_id"]))
    parts = durable(bank_split(v.correct, 0.05).withColumnRenamed("sample_id", "row_id"))
    labels = v.eval_long.select("row_id", "model", "correct").join(parts.where("part = 'train'"), "row_id", "left_semi")
    return words, parts, labels, T.train_rejectors(words, labels, MODELS)


def _balanced(scores, labels):
    """Per source: do the errors on its training rows add up to nothing? They do at the optimum, as the intercept is free."""
    rows = scores.join(labels.where("correct IS NOT NULL").withColumnRenamed("model", "source"), ["row_id", "source"])
    return rows.groupBy("source").agg((F.abs(F.avg(sigmoid(F.col("logit")) - F.col("correct"))) < 1e-3).alias("balanced"))


_BANK = """WITH parts AS (SELECT sample_id, CASE WHEN r <= floor(n * 0.05) THEN 'bank' ELSE 'train' END AS part FROM (
      SELECT sample_id, row_number() OVER (ORDER BY gaps, md5('bank-' || sample_id), sample_id) AS r, count(*) OVER () AS n
      FROM (SELECT sample_id, count(*) FILTER (correct IS NULL) AS gaps FROM correct GROUP BY 1))),
    sources AS (SELECT DISTINCT model AS source FROM correct)"""


@query("l2_router_training", f"{_BANK} SELECT source, part, count(*) AS n, true AS balanced FROM parts, sources GROUP BY ALL")
def _(v):
    words, parts, labels, rejectors = _routed_training(v)
    scored = durable(T.score_rejectors(words.join(parts, "row_id"), rejectors, MODELS, ["row_id", "part"]))
    counts = scored.where("logit IS NOT NULL").groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(_balanced(scored, labels), "source")


@query("l3_bank_predictions", f"{_BANK} SELECT sample_id AS row_id, source, true AS balanced FROM parts, sources WHERE part = 'bank'")
def _(v):
    words, parts, labels, rejectors = _routed_training(v)
    scored = durable(T.score_rejectors(words.join(parts, "row_id"), rejectors, MODELS, ["row_id", "part"]))
    bank = scored.where("part = 'bank' AND logit IS NOT NULL").select("row_id", "source")
    return bank.join(_balanced(scored, labels), "source")


@query(
    "l4_cross_model_scoring",
    f"""WITH ranked AS (SELECT doc_id AS row_id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
    SELECT s.model AS source, e.model AS target, CAST(sum(correct) AS BIGINT) AS n_pos, CAST(sum(1 - correct) AS BIGINT) AS n_neg, true AS rated, true AS balanced
    FROM ranked JOIN eval_long e USING (row_id), (SELECT DISTINCT model FROM eval_long) s WHERE correct IS NOT NULL AND r <= ceil(n * {_SHARE}) GROUP BY ALL""",
)
def _(v):
    prompts = _prompts(v)
    parts = durable(T.train_test(prompts, 42, ["row_id"]).select("row_id", "part"))
    words = durable(B.hashed_words(prompts, ["row_id"]).join(parts, "row_id"))
    labels = v.eval_long.select("row_id", "model", "correct").join(parts.where("part = 'train'"), "row_id", "left_semi")
    rejectors = T.train_rejectors(words, labels, MODELS)
    scores = durable(T.score_rejectors(words, rejectors, MODELS, ["row_id", "part"]))
    rated = X.transfer_metrics(scores.where("part = 'test'"), v.truth, ["row_id"])
    return rated.join(_balanced(scores, labels), "source").select("source", "target", "n_pos", "n_neg", F.col("auroc").between(0, 1).alias("rated"), "balanced")


RULES = tuple(rule_name(op, b, f) for b in BLEU_GRID for f in F1_GRID for op in ("or", "and"))


@query(
    "l6_rule_sweep",
    f"""WITH rules AS (SELECT op || '_' || b || '_' || f AS rule, op = 'or' AS either, CAST(b AS DOUBLE) AS b, CAST(f AS DOUBLE) AS f
      FROM (VALUES ('or'), ('and')) o(op), (VALUES {", ".join(f"('{b}')" for b in BLEU_GRID)}) bb(b), (VALUES {", ".join(f"('{f}')" for f in F1_GRID)}) ff(f)), lab AS (
      SELECT rule, model, row_id, CASE WHEN task NOT IN ('narrative_qa', 'wmt_14', 'natural_qa') THEN CAST(stats_exact_match AS INT)
        WHEN either THEN CAST(coalesce(stats_bleu_4 >= b, false) OR coalesce(nullif(stats_f1_score, CAST('NaN' AS DOUBLE)) >= f, false) AS INT)
        ELSE CAST(coalesce(stats_bleu_4 >= b, false) AND coalesce(nullif(stats_f1_score, CAST('NaN' AS DOUBLE)) >= f, false) AS INT) END AS label
      FROM answers, rules),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY rule, model ORDER BY md5('42-' || row_id), row_id) AS r, count(*) OVER (PARTITION BY rule, model) AS n FROM lab)
    SELECT model, rule, row_id, label, true AS scored FROM drawn WHERE r <= ceil(n * {_SHARE}) AND label IS NOT NULL""",
)
def _(v):
    """All ten models under all ninety composite rules: nine hundred rejectors from one training."""
    answers = v.answers.withColumnsRenamed({"stats_bleu_4": "bleu_complete", "stats_f1_score": "f1_complete"})
    swept = T.rule_sweep(answers.join(_prompts(v), "row_id"), MODELS, RULES, train_rows=None)
    return swept.select("model", "rule", "row_id", "label", F.col("logit").isNotNull().alias("scored"))


def _network_scores(v):
    data = v.embedded
    train = data.where("part = 'train'").select("vec_id", "embedding").join(
        v.embedded_correct.withColumnRenamed("sample_id", "vec_id"), "vec_id"
    )
    networks = T.train_networks(train, MODELS, seed=0, hidden=(1,), max_steps=1000)
    test = data.where("part = 'test'").select(F.col("vec_id").alias("sample_id"), "embedding")
    return B.score_networks(test, networks, MODELS, ["sample_id"])


@query("l8_network_scores", "SELECT vec_id AS sample_id, model, true AS scored FROM embeddings, (SELECT DISTINCT model FROM embedded_correct) m WHERE vec_id % 5 = 0")
def _(v):
    return _network_scores(v).select("sample_id", "model", F.col("logit").between(0, 1).alias("scored"))


@query("m10_network_router", "SELECT vec_id AS sample_id, true AS known_model FROM embeddings WHERE vec_id % 5 = 0")
def _(v):
    routes = R.best_scored(_network_scores(v), ["sample_id"])
    return routes.select("sample_id", F.col("model").isin(*MODELS).alias("known_model"))
