"""Labelling rules, overlap scoring, entailment decisions and document dispatch."""

from __future__ import annotations

from pyspark.sql import functions as F

from selroute.functions import documents as D
from selroute.functions import text as T
from selroute.functions.scores import arg_max_name, to_binary
from selroute.operators import entailment as N
from selroute.operators import labels as L
from selroute.operators import metrics as M
from selroute.operators import overlap as O
from selroute.plans.registry import query, r6, rounded

# SQL pieces. RE2 has no look-around, so the article pattern runs twice to reach neighbours.
_WS = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PUNCT = T.ASCII_PUNCTUATION.replace("'", "''")
_ARTICLE = r"(^|[^\pL\pN_])(?:a|an|the)($|[^\pL\pN_])"


def _tokens_sql(text: str) -> str:
    bare = f"translate(lower({text}), '{_PUNCT}', '')"
    for _ in range(2):
        bare = f"regexp_replace({bare}, '{_ARTICLE}', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array({bare}, '{_WS}'), lambda w: w <> '')"


def _mteval_sql(text: str) -> str:
    line = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, mark in T.MTEVAL_ENTITIES:
        line = f"replace({line}, '{entity}', '{mark}')"
    line = f"' ' || {line} || ' '"
    for pattern, replacement in T.MTEVAL_13A:
        line = f"regexp_replace({line}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return f"list_filter(regexp_split_to_array({line}, '{_WS}'), lambda w: w <> '')"


def f1_sql(pairs: str, key: str = "row_id", pred: str = "pred", ref: str = "ref") -> str:
    """CTEs ending in ``f1s(key, f1)`` for the named pair relation."""
    return f"""tok AS (SELECT {key}, {_tokens_sql(pred)} AS p, {_tokens_sql(ref)} AS r FROM {pairs}),
    pc AS (SELECT {key}, w, count(*) AS c FROM (SELECT {key}, unnest(p) AS w FROM tok) GROUP BY ALL),
    rc AS (SELECT {key}, w, count(*) AS c FROM (SELECT {key}, unnest(r) AS w FROM tok) GROUP BY ALL),
    same AS (SELECT {key}, sum(least(pc.c, rc.c)) AS s FROM pc JOIN rc USING ({key}, w) GROUP BY ALL),
    f1s AS (SELECT {key}, CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 WHEN s IS NULL THEN 0.0
      ELSE 2 * (s / len(p)) * (s / len(r)) / (s / len(p) + s / len(r)) END AS f1 FROM tok LEFT JOIN same USING ({key}))"""


def bleu_sql(pairs: str) -> str:
    """CTEs ending in ``bleus(row_id, bleu)``."""
    grams = "SELECT row_id, n, array_to_string(list_slice({c}, i, i + n - 1), ' ') AS g FROM bt, range(1, 5) a(n), unnest(range(1, CAST(len({c}) AS BIGINT) - n + 2)) b(i)"
    return f"""bt AS (SELECT row_id, {_mteval_sql('pred')} AS p, {_mteval_sql('ref')} AS r FROM {pairs}),
    pg AS (SELECT row_id, n, g, count(*) AS c FROM ({grams.format(c='p')}) GROUP BY ALL),
    rg AS (SELECT row_id, n, g, count(*) AS c FROM ({grams.format(c='r')}) GROUP BY ALL),
    mt AS (SELECT row_id, n, sum(least(pg.c, rg.c)) AS m FROM pg JOIN rg USING (row_id, n, g) GROUP BY ALL),
    ords AS (SELECT row_id, n, greatest(len(p) - n + 1, 0) AS total, coalesce(m, 0) AS m FROM (SELECT row_id, p, n FROM bt, range(1, 5) a(n)) x LEFT JOIN mt USING (row_id, n)),
    miss AS (SELECT *, sum(CAST(total > 0 AND m = 0 AS INT)) OVER (PARTITION BY row_id ORDER BY n) AS k FROM ords),
    lg AS (SELECT row_id, sum(ln(CASE WHEN m > 0 THEN m / total ELSE 1.0 / (2.0 ** k * total) END)) / count(*) AS l FROM miss WHERE total > 0 GROUP BY 1),
    hit AS (SELECT row_id, sum(m) AS m FROM ords GROUP BY 1),
    bleus AS (SELECT bt.row_id, CASE WHEN hit.m > 0 THEN CASE WHEN len(p) >= len(r) THEN 1.0 ELSE exp(1 - len(r) / len(p)) END * exp(l) ELSE 0.0 END AS bleu
      FROM bt JOIN hit USING (row_id) LEFT JOIN lg USING (row_id))"""


@query("h1_normalised_answers", f"SELECT doc_id, array_to_string({_tokens_sql('text')}, ' ') AS answer FROM documents")
def _(v):
    return v.table("documents").select("doc_id", T.normalise_answer(F.col("text")).alias("answer"))


@query("h2_token_f1", f"WITH {f1_sql('pairs')} SELECT row_id, round(f1, 6) AS f1_complete FROM f1s")
def _(v):
    return rounded(O.score_token_f1(v.pairs, "row_id"), "f1_complete")


@query(
    "h2_token_f1_documents",
    f"""WITH dp AS (SELECT d.doc_id AS row_id, d.text AS pred, b.text AS ref FROM documents d JOIN documents b ON b.doc_id = d.doc_id - 1),
    {f1_sql('dp')} SELECT row_id, round(f1, 6) AS f1_complete FROM f1s""",
)
def _(v):
    docs = v.table("documents")
    before = docs.select((F.col("doc_id") + 1).alias("row_id"), F.col("text").alias("ref"))
    # Both sides are whole tables of texts: they meet by a shuffle, never by a broadcast, which also spreads the scoring.
    pairs = docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("pred")).join(before.hint("merge"), "row_id")
    return rounded(O.score_token_f1(pairs, "row_id"), "f1_complete")


@query("h3_sentence_bleu", f"WITH {bleu_sql('pairs')} SELECT row_id, round(bleu, 6) AS bleu_complete FROM bleus")
def _(v):
    return rounded(O.score_bleu4(v.pairs, "row_id"), "bleu_complete")


@query("h4_first_reference", "SELECT row_id, refs[1].output.text AS ref FROM run_rows")
def _(v):
    stored = v.run_rows.select("row_id", F.to_json("references").alias("references_json"))
    refs = F.from_json("references_json", "array<struct<output: struct<text: string>, tags: array<string>>>")
    return stored.select("row_id", T.first_reference(refs).alias("ref"))


_BOX = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"


@query(
    "h5_boxed_answer",
    f"SELECT row_id, CASE WHEN regexp_matches(predicted_text, '{_BOX}') THEN regexp_extract(predicted_text, '{_BOX}', 1) END AS boxed FROM run_rows",
)
def _(v):
    return v.run_rows.select("row_id", T.boxed_answer(F.col("predicted_text")).alias("boxed"))


_LETTER = """coalesce((SELECT ['A', 'B', 'C', 'D', 'E', 'F'][max(i)] FROM (SELECT unnest(range(1, len(refs) + 1)) AS i) WHERE refs[i].tags = ['correct']), '')"""


@query("h6_correct_option", f"SELECT row_id, {_LETTER} AS letter FROM run_rows")
def _(v):
    return v.run_rows.select("row_id", T.correct_option(F.col("references")).alias("letter"))


@query(
    "b12_reference_text",
    "SELECT row_id, array_to_string(list_transform(refs, lambda r: r.output.text), chr(10) || '---' || chr(10)) AS reference_text FROM run_rows",
)
def _(v):
    return v.run_rows.select("row_id", T.reference_texts(F.col("references")).alias("reference_text"))


_KEYS = """keyed AS (SELECT event_id, string_agg(name, chr(31) ORDER BY name) AS signature FROM (
      SELECT event_id, CASE WHEN path = '$' THEN key ELSE substr(replace(path, '"', ''), 3) || '.' || key END AS name
      FROM docs_json, json_tree(docs_json.doc) t WHERE t.type <> 'OBJECT' AND fullkey NOT LIKE '%[%' AND t.key IS NOT NULL) GROUP BY 1)"""


@query("b2_key_signature", f"WITH {_KEYS} SELECT event_id, replace(signature, chr(31), ',') AS signature FROM keyed")
def _(v):
    keys = D.leaf_keys(F.col("doc"))
    return v.docs_json.select("event_id", F.array_join(keys, ",").alias("signature"))


def _text_sql(expr: str) -> str:
    return f"""CASE WHEN json_type({expr}) = 'ARRAY' THEN array_to_string(from_json({expr}, '["VARCHAR"]'), ' | ') ELSE coalesce({expr} ->> '$', '') END"""


def _signature(keys: list[str]) -> str:
    return ",".join(sorted(keys)).replace("'", "''")


def _prompt_case() -> str:
    arms = []
    for keys, fields, _ in D.DOCUMENT_RULES:
        def path(f):
            return "doc -> '$." + f + "'"

        chunks = " || ' ' || ".join(f"'{f}: ' || {_text_sql('(' + path(f) + ')')}" for f in fields)
        arms.append(f"WHEN '{_signature(keys)}' THEN {chunks}")
    return "CASE replace(signature, chr(31), ',') " + " ".join(arms) + " END"


def _metric_case() -> str:
    arms = [f"WHEN '{_signature(k)}' THEN {m}" for k, _, m in D.DOCUMENT_RULES]
    return "CASE replace(signature, chr(31), ',') " + " ".join(arms) + " END"


def _name_case() -> str:
    arms = [f"WHEN '{_signature(k)}' THEN '{m}'" for k, _, m in D.DOCUMENT_RULES]
    return "CASE replace(signature, chr(31), ',') " + " ".join(arms) + " END"


_BINARY = "CASE WHEN {x} IS NULL THEN NULL WHEN lower(trim({x})) = 'true' THEN 1 WHEN try_cast({x} AS DOUBLE) <> 0 THEN 1 ELSE 0 END"


@query("h7_prompt_text", f"WITH {_KEYS} SELECT event_id, {_prompt_case()} AS input FROM keyed JOIN docs_json USING (event_id) WHERE {_name_case()} IS NOT NULL")
def _(v):
    known, _rest = L.prepare_prompts(v.docs_json)
    return known.select("event_id", "input")


@query("h8_value_text", f"SELECT event_id, {_text_sql(chr(40) + 'doc -> ' + chr(39) + '$.options' + chr(39) + chr(41))} AS options, {_text_sql('(doc -> ' + chr(39) + '$.question' + chr(39) + ')')} AS question FROM docs_json")
def _(v):
    doc = F.try_parse_json("doc")
    return v.docs_json.select(
        "event_id",
        D.stringify(D.field_value(doc, F.lit("options"))).alias("options"),
        D.stringify(D.field_value(doc, F.lit("question"))).alias("question"),
    )


@query("j10_rule_dispatch", f"WITH {_KEYS} SELECT event_id, {_name_case()} AS metric FROM keyed")
def _(v):
    return L.dispatch_documents(v.docs_json).select("event_id", "metric")


@query("j10_quarantine", f"WITH {_KEYS} SELECT event_id, doc FROM keyed JOIN docs_json USING (event_id) WHERE {_name_case()} IS NULL")
def _(v):
    _known, rest = L.prepare_prompts(v.docs_json)
    return rest.select("event_id", "doc")


@query("j11_to_binary", f"SELECT event_id, {_BINARY.format(x='acc')} AS correctness FROM docs_json")
def _(v):
    return v.docs_json.select("event_id", to_binary(F.col("acc")).alias("correctness"))


@query(
    "n3_prompts_and_correctness",
    f"""WITH {_KEYS}, c AS (SELECT event_id, {_prompt_case()} AS input, {_metric_case()} AS x FROM keyed JOIN docs_json USING (event_id) WHERE {_name_case()} IS NOT NULL)
    SELECT event_id, input, {_BINARY.format(x='x')} AS correctness FROM c""",
)
def _(v):
    known, _rest = L.prepare_prompts(v.docs_json)
    return known.select("event_id", "input", "correctness")


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {repr(x)}" for k, x in table.items()) + " END"


_VALUE = "CASE metric " + " ".join(f"WHEN '{m}' THEN {m}" for m in L.METRIC_THRESHOLD) + " END"
_LABELLED = f"""ruled AS (SELECT *, {_case(L.TASK_METRIC, 'task')} AS metric FROM answers),
    hits AS (SELECT *, {_case(L.METRIC_THRESHOLD, 'metric')} AS cut, nullif({_VALUE}, CAST('NaN' AS DOUBLE)) AS val FROM ruled)"""


@query("c8_rule_lookup", f"WITH {_LABELLED} SELECT row_id, model, task, metric, CAST(cut AS DOUBLE) AS threshold FROM hits")
def _(v):
    metric = L.task_metric(F.col("task"))
    return v.answers.select("row_id", "model", "task", metric.alias("metric"), L.metric_threshold(metric).alias("threshold"))


@query("j1_threshold_label", f"WITH {_LABELLED} SELECT row_id, model, CAST(coalesce(val >= cut, false) AS INT) AS correct FROM hits")
def _(v):
    return L.threshold_label(v.answers).select("row_id", "model", "correct")


@query(
    "j2_rule_override",
    f"""WITH {_LABELLED} SELECT row_id, model, CASE WHEN metric IN ('stats_f1_score', 'stats_bleu_4') THEN Een
      ELSE CAST(coalesce(val >= cut, false) AS INT) END AS correct FROM hits""",
)
def _(v):
    return L.threshold_label(v.answers, override="Een").select("row_id", "model", "correct")


_GRID = f"""grid AS (SELECT op, b, f, op || '_' || b || '_' || f AS rule FROM (VALUES ('or'), ('and')) o(op),
    (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in L.BLEU_GRID)}) x(b), (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in L.F1_GRID)}) y(f))"""
_CLEAN = "clean AS (SELECT * REPLACE (nullif(stats_f1_score, CAST('NaN' AS DOUBLE)) AS stats_f1_score) FROM answers)"
_RULE = """CAST(CASE op WHEN 'or' THEN coalesce(stats_bleu_4 >= b, false) OR coalesce(stats_f1_score >= f, false)
    ELSE coalesce(stats_bleu_4 >= b, false) AND coalesce(stats_f1_score >= f, false) END AS INT)"""


@query("j3_composite_rules", f"WITH {_CLEAN}, {_GRID} SELECT rule, sum({_RULE})::BIGINT AS n_correct, count(*) AS n FROM clean, grid GROUP BY 1")
def _(v):
    rules = L.composite_rules(v.answers, ["row_id", "model"], "stats_bleu_4", "stats_f1_score")
    return rules.groupBy("rule").agg(F.sum("value").alias("n_correct"), F.count(F.lit(1)).alias("n"))


@query("j3_composite_rules_scored", f"""WITH {f1_sql('pairs')}, {bleu_sql('pairs')}, {_GRID},
    sc AS (SELECT row_id, f1, bleu FROM f1s JOIN bleus USING (row_id))
    SELECT rule, sum(CAST(CASE op WHEN 'or' THEN bleu >= b OR f1 >= f ELSE bleu >= b AND f1 >= f END AS INT))::BIGINT AS n_correct FROM sc, grid GROUP BY 1""")
def _(v):
    scored = O.score_bleu4(v.pairs, "row_id").join(O.score_token_f1(v.pairs, "row_id"), "row_id")
    return L.composite_rules(scored, ["row_id"]).groupBy("rule").agg(F.sum("value").alias("n_correct"))


@query(
    "j4_blends",
    f"""WITH {_CLEAN}, al AS (SELECT row_id, model, 'alpha_' || a AS rule, a * stats_f1_score + (1 - a) * stats_bleu_4 AS value FROM clean,
      (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in L.ALPHA_GRID)}) g(a)),
    alls AS (FROM al UNION ALL SELECT row_id, model, 'combo_max', greatest(stats_bleu_4, stats_f1_score) FROM clean
      UNION ALL SELECT row_id, model, 'combo_min', least(stats_bleu_4, stats_f1_score) FROM clean)
    SELECT row_id, model, rule, round(value, 6) AS value FROM alls""",
)
def _(v):
    return rounded(L.blends(v.answers, ["row_id", "model"], "stats_bleu_4", "stats_f1_score"), "value")


@query(
    "h11_blend_extremes",
    f"""WITH {_CLEAN} SELECT row_id, model, round(0.3 * stats_f1_score + 0.7 * stats_bleu_4, 6) AS blend, round(greatest(stats_f1_score, stats_bleu_4), 6) AS high,
      round(least(stats_f1_score, stats_bleu_4), 6) AS low, round(abs(stats_f1_score - stats_bleu_4), 6) AS gap FROM clean""",
)
def _(v):
    from selroute.functions.scores import blend, nan_to_null

    f, b = nan_to_null(F.col("stats_f1_score")), F.col("stats_bleu_4")
    return v.answers.select(
        "row_id", "model", r6(blend(f, b, F.lit(0.3))).alias("blend"), r6(F.greatest(f, b)).alias("high"),
        r6(F.least(f, b)).alias("low"), r6(F.abs(f - b)).alias("gap"),
    )


@query(
    "j5_composite_labels",
    f"""WITH {_CLEAN}, {_GRID}, lab AS (SELECT rule, model, CASE WHEN task IN ('narrative_qa', 'wmt_14', 'natural_qa') THEN {_RULE}
      ELSE CAST(stats_exact_match AS INT) END AS correct FROM clean, grid)
    SELECT rule, model, sum(correct)::BIGINT AS n_correct, count(correct) AS n_known FROM lab GROUP BY ALL""",
)
def _(v):
    labels = L.composite_label(v.answers, ["row_id", "model"], "stats_bleu_4", "stats_f1_score")
    return labels.groupBy("rule", "model").agg(F.sum("correct").alias("n_correct"), F.count("correct").alias("n_known"))


_CUTS = [str(b) for b in L.BLEU_GRID]


@query(
    "i22_composite_grid_report",
    f"""WITH {_CLEAN}, {_GRID}, lab AS (SELECT op, b, f, rule, model, row_id, CASE WHEN task IN ('narrative_qa', 'wmt_14', 'natural_qa') THEN {_RULE}
      ELSE CAST(stats_exact_match AS INT) END AS label FROM clean, grid),
    rk AS (SELECT op, b, f, rule, model, label, rank() OVER (PARTITION BY model, rule ORDER BY logit)
      + (count(*) OVER (PARTITION BY model, rule, logit) - 1) / 2.0 AS rk FROM lab JOIN eval_long USING (row_id, model) WHERE label IS NOT NULL),
    a AS (SELECT op, b, f, model, (sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0) AS auroc
      FROM rk GROUP BY ALL)
    SELECT op, f AS f1, {', '.join(f'round(avg(auroc) FILTER (b = {c}), 6) AS "{c}"' for c in _CUTS)} FROM a GROUP BY 1, 2""",
)
def _(v):
    labels = L.composite_label(v.answers, ["row_id", "model"], "stats_bleu_4", "stats_f1_score").withColumnRenamed("correct", "label")
    predictions = labels.where("label IS NOT NULL").join(v.eval_long.select("row_id", "model", "logit"), ["row_id", "model"])
    parts = F.split("rule", "_")
    cells = M.eval_metrics(predictions, ["model", "rule"]).select(
        F.get(parts, 0).alias("op"), F.get(parts, 1).alias("bleu"), F.get(parts, 2).cast("double").alias("f1"), "auroc"
    )
    wide = cells.groupBy("op", "f1").pivot("bleu", _CUTS).agg(F.avg("auroc"))
    return wide.select("op", "f1", *[r6(F.col(f"`{c}`")).alias(c) for c in _CUTS]).orderBy("op", F.desc("f1"))


_PAIRS = """ep AS (SELECT row_id, CAST(i - 1 AS INT) AS ref_pos, w.direction, CASE w.direction WHEN 0 THEN predicted_text ELSE refs[i].output.text END AS premise,
      CASE w.direction WHEN 0 THEN refs[i].output.text ELSE predicted_text END AS hypothesis
      FROM (SELECT *, unnest(range(1, len(refs) + 1)) AS i FROM run_rows WHERE stats_f1_score IS NOT NULL OR stats_bleu_4 IS NOT NULL), (VALUES (0), (1)) w(direction))"""


@query("j6_entailment_pairs", f"WITH {_PAIRS} SELECT * FROM ep")
def _(v):
    return N.entailment_pairs(v.run_rows)


@query("j7_class_labels", "SELECT * FROM pair_labels")
def _(v):
    return N.pair_labels(v.class_scores)


@query("h12_arg_max_name", "SELECT row_id, ref_pos, direction, label AS best FROM pair_labels")
def _(v):
    return v.class_scores.select("row_id", "ref_pos", "direction", arg_max_name(F.col("scores"), N.CLASS_NAMES).alias("best"))


def _decide(src: str) -> str:
    return f"""two AS (SELECT row_id, ref_pos, max(label) FILTER (direction = 0) || '>' || max(label) FILTER (direction = 1) AS ab FROM {src} GROUP BY ALL),
    decided AS (SELECT row_id, CAST(bool_and(ab = 'entailment>entailment') AS INT) AS Vee, CAST(bool_or(ab = 'entailment>entailment') AS INT) AS Eee,
      CAST(bool_and(ab IN ('entailment>entailment', 'entailment>neutral', 'neutral>entailment')) AS INT) AS Ven,
      CAST(bool_or(ab IN ('entailment>entailment', 'entailment>neutral', 'neutral>entailment')) AS INT) AS Een FROM two GROUP BY 1)"""


@query(
    "j8_entailment_decisions",
    f"""WITH {_decide('pair_labels')} SELECT c.conv_id * 1000 + c.turn AS row_id, Vee, Eee, Ven, Een FROM conversations c
      LEFT JOIN decided d ON d.row_id = c.conv_id * 1000 + c.turn AND c.role <> 'system'""",
)
def _(v):
    turns = v.table("conversations").selectExpr("conv_id * 1000 + turn AS row_id", "role")
    asked = v.class_scores.join(turns.where("role <> 'system'"), "row_id", "left_semi")
    return N.add_decisions(turns.select("row_id"), N.decisions(N.pair_labels(asked)))


_STAND_IN = f"""{f1_sql('ep', 'row_id, ref_pos, direction', 'premise', 'hypothesis')},
    ls AS (SELECT row_id, ref_pos, direction, [1 - f1, f1, 0.4] AS sc FROM f1s),
    lb AS (SELECT row_id, ref_pos, direction, ['contradiction', 'entailment', 'neutral'][list_position(sc, list_max(sc))] AS label FROM ls)"""


@query("l7_pair_scores", f"WITH {_PAIRS}, {_STAND_IN} SELECT row_id, ref_pos, direction, label FROM lb")
def _(v):
    return N.pair_labels(N.overlap_stand_in(N.entailment_pairs(v.run_rows)))


_CAPABLE = f"""cap AS (SELECT row_id, task, CASE task WHEN 'math' THEN stats_math_equiv_chain_of_thought ELSE stats_exact_match END AS recorded,
      CASE task WHEN 'math' THEN CASE WHEN regexp_matches(predicted_text, '{_BOX}') THEN regexp_extract(predicted_text, '{_BOX}', 1) END ELSE predicted_text END AS pred,
      CASE task WHEN 'math' THEN CASE WHEN regexp_matches(refs[1].output.text, '{_BOX}') THEN regexp_extract(refs[1].output.text, '{_BOX}', 1) END ELSE {_LETTER} END AS ref
      FROM run_rows WHERE task IN ('math', 'commonsense')),
    ep AS (SELECT row_id, 0 AS ref_pos, direction, CASE direction WHEN 0 THEN pred ELSE ref END AS premise, CASE direction WHEN 0 THEN ref ELSE pred END AS hypothesis
      FROM cap, (VALUES (0), (1)) w(direction) WHERE pred IS NOT NULL AND ref IS NOT NULL)"""


@query(
    "j9_capability_check",
    f"""WITH {_CAPABLE}, {_STAND_IN}, {_decide('lb')} SELECT row_id, task, coalesce(Een, 0) AS decision, recorded, coalesce(Een, 0) = recorded AS equal
    FROM cap LEFT JOIN decided USING (row_id)""",
)
def _(v):
    decided = N.decisions(N.pair_labels(N.overlap_stand_in(N.capability_pairs(v.run_rows))))
    return N.capability_check(v.run_rows, decided)


@query(
    "j9_agreement_count",
    f"""WITH {_CAPABLE}, {_STAND_IN}, {_decide('lb')} SELECT task, sum(CAST(coalesce(Een, 0) = recorded AS INT))::BIGINT AS n_equal, count(*) AS n
    FROM cap LEFT JOIN decided USING (row_id) GROUP BY 1""",
)
def _(v):
    decided = N.decisions(N.pair_labels(N.overlap_stand_in(N.capability_pairs(v.run_rows))))
    checked = N.capability_check(v.run_rows, decided)
    return checked.groupBy("task").agg(F.sum(F.col("equal").cast("int")).alias("n_equal"), F.count(F.lit(1)).alias("n"))
