"""File scans and sinks, path facts, projections and filters.

Queries on files first write data that Spark derives from the driver tables to a new folder below the shared
checkpoint folder, then read it with the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from selroute.functions import paths as P
from selroute.operators import reshape as R
from selroute.plans.registry import query, r6
from selroute.plans.views import _FOLDER, MODELS
from selroute.schemas import INSTANCES, PREDICTIONS, REQUESTS
from selroute.session import scratch_path
from selroute.sources import leaderboard as B
from selroute.sources import runs as S
from selroute.sources import tables as T

_FOLDER_SQL = _FOLDER.replace("AS STRING)", "AS VARCHAR)")

# The three tables of a run folder, from conversation turns. Instances exist for user turns only.
_RUN_SQL = f"""turns AS (SELECT *, {_FOLDER_SQL} AS folder, concat('id', conv_id, '_', turn) AS instance_id FROM conversations)"""


def _turns(v):
    return v.table("conversations").selectExpr(
        "*", f"{_FOLDER} AS folder", "concat('id', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS instance_id"
    )


def _predictions(v):
    stats = ", ".join(f"'{s}', {x}" for s, x in (
        ("exact_match", "CAST(turn % 2 AS DOUBLE)"), ("quasi_exact_match", "CAST(NULL AS DOUBLE)"),
        ("f1_score", "CAST(conv_id % 10 AS DOUBLE) / 10"), ("bleu_4", "CAST(NULL AS DOUBLE)"),
        ("final_number_exact_match", "CAST(NULL AS DOUBLE)"), ("math_equiv_chain_of_thought", "CAST(NULL AS DOUBLE)"),
        ("rouge_l", "CAST(turn % 4 AS DOUBLE) / 4")))  # one statistic that no rule knows
    return _turns(v).selectExpr("folder", "instance_id", "text AS predicted_text", f"named_struct({stats}) AS stats")


def _requests(v):
    return _turns(v).where("role <> 'system'").selectExpr(
        "folder", "instance_id",
        "named_struct('model', concat('org/', role), 'prompt', concat('Q', CAST(turn AS STRING)), 'max_tokens', turn + 16) AS request",
    )


def _instances(v):
    return _turns(v).where("role = 'user'").selectExpr(
        "folder", "instance_id AS id", "named_struct('text', role) AS input",
        "array(named_struct('output', named_struct('text', role), 'tags', array('correct'))) AS references",
    )


def _write_array_files(df, root: str, name: str) -> None:
    """One JSON array per run folder. A run folder is small by nature (here fifty conversations)."""
    rest = [c for c in df.columns if c != "folder"]
    arrays = df.groupBy("folder").agg(F.to_json(F.collect_list(F.struct(*rest))).alias("value"))
    arrays.withColumn("run", F.element_at(F.split("folder", "/"), -1)).select("run", "value").write.partitionBy("run").text(
        f"{root}/{name}"
    )


def _array_scan(v, df, schema, name):
    root = scratch_path(v.spark, "runs")
    _write_array_files(df, root, name)
    scanned = S.read_array_files(v.spark, f"{root}/{name}", "*.txt", schema)
    return scanned.withColumn("folder", F.concat(F.lit("suite/"), P.decoded(F.regexp_extract("folder", r"run=(.*)$", 1))))


@query(
    "a1_json_array_scan",
    f"WITH {_RUN_SQL} SELECT folder, instance_id, text AS predicted_text, CAST(turn % 2 AS DOUBLE) AS exact_match, conv_id % 10 / 10 AS f1_score, turn % 4 / 4 AS rouge_l FROM turns",
)
def _(v):
    scanned = _array_scan(v, _predictions(v), PREDICTIONS, "display_predictions")
    return scanned.select("folder", "instance_id", "predicted_text", "stats.exact_match", "stats.f1_score", "stats.rouge_l")


@query(
    "n1_run_table",
    f"""WITH {_RUN_SQL} SELECT folder, split_part(split_part(folder, '/', 2), ':', 1) AS task, instance_id, text AS predicted_text,
      CASE WHEN role <> 'system' THEN 'org_' || role END AS model, CASE WHEN role <> 'system' THEN 'Q' || turn END AS request_prompt,
      CASE WHEN role = 'user' THEN role END AS input_text, conv_id % 10 / 10 AS stats_f1_score, turn % 4 / 4 AS stats_rouge_l, turn + 16 AS request_max_tokens FROM turns WHERE role <> 'system'""",
)
def _(v):
    joined = S.join_run_tables(
        _array_scan(v, _predictions(v), PREDICTIONS, "display_predictions"),
        _array_scan(v, _requests(v), REQUESTS, "display_requests"),
        _array_scan(v, _instances(v), INSTANCES, "instances"),
    )
    path = scratch_path(v.spark, "per_model")
    S.write_per_model(joined, path)
    return v.spark.read.parquet(path).select(
        "folder", "task", "instance_id", "predicted_text", "model", "request_prompt", "input_text", "stats_f1_score", "stats_rouge_l", "request_max_tokens"
    )


@query(
    "c1_chained_left_join",
    f"""WITH {_RUN_SQL}, q AS (SELECT folder, instance_id, 'Q' || turn AS prompt FROM turns WHERE role <> 'system'),
    i AS (SELECT folder, instance_id, role AS input_text FROM turns WHERE role = 'user')
    SELECT folder, instance_id, prompt AS request_prompt, input_text FROM turns LEFT JOIN q USING (folder, instance_id) LEFT JOIN i USING (folder, instance_id)""",
)
def _(v):
    return S.join_run_tables(_predictions(v), _requests(v), _instances(v)).select("folder", "instance_id", "request_prompt", "input_text")


@query(
    "b1_flatten_structs",
    f"""WITH {_RUN_SQL} SELECT folder, instance_id, text AS predicted_text, CAST(turn % 2 AS DOUBLE) AS stats_exact_match, conv_id % 10 / 10 AS stats_f1_score FROM turns""",
)
def _(v):
    flat = R.flatten_struct(_predictions(v))
    return flat.select("folder", "instance_id", "predicted_text", "stats_exact_match", "stats_f1_score")


@query("q13_fan_out_report", "SELECT 'u' || user_id AS folder, event_type AS instance_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def _(v):
    rows = v.table("events").selectExpr("concat('u', CAST(user_id AS STRING)) AS folder", "event_type AS instance_id")
    return S.fan_out(rows)


def _sample_files(v):
    """Leaderboard-like rows with the path parts of their file."""
    return v.docs_json.join(v.table("events").selectExpr("event_id", "user_id % 7 AS file_no", "event_type"), "event_id")


@query(
    "a2_json_lines_scan",
    """SELECT 'org_m' || (e.user_id % 7) AS model, count(*) AS n, count(exact_match) AS n_exact, CAST(sum(length(doc)) AS BIGINT) AS doc_chars
    FROM docs_json JOIN events e USING (event_id) GROUP BY 1""",
)
def _(v):
    root = scratch_path(v.spark, "samples")
    rows = _sample_files(v).selectExpr("concat('org_m', CAST(file_no AS STRING)) AS model", "doc", "exact_match", "acc", "acc_norm", "em", "prompt_level_loose_acc")
    # doc is written as a JSON object, as in a sample file, and read back as text
    quoted = rows.select("model", F.concat(F.lit('{"doc":'), "doc", F.lit(","), F.expr(
        "substr(to_json(struct(exact_match, acc, acc_norm, em, prompt_level_loose_acc), map('ignoreNullFields', 'false')), 2)")).alias("value"))
    quoted.write.partitionBy("model").text(root)
    scanned = B.read_samples(v.spark, f"{root}/*/*.txt")
    return scanned.groupBy(F.regexp_replace("model", "^model=", "").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.count("exact_match").alias("n_exact"), F.sum(F.length("doc")).alias("doc_chars")
    )


@query(
    "n2_leaderboard_table",
    """SELECT 'org_m' || (e.user_id % 7) AS model, e.event_type AS task, count(*) AS n, count(acc) AS n_acc FROM docs_json JOIN events e USING (event_id) GROUP BY ALL""",
)
def _(v):
    root = scratch_path(v.spark, "leaderboard")
    rows = _sample_files(v).selectExpr(
        "concat('org_m', CAST(file_no AS STRING)) AS model", "event_type AS task", "to_json(struct(doc, exact_match, acc, acc_norm, em, prompt_level_loose_acc)) AS value"
    )
    rows.write.partitionBy("model", "task").text(root)
    scanned = B.read_samples(v.spark, f"{root}/*/*/*.txt")
    # Spark escapes partition names once more on disk, and names the files itself; model and task sit in the folders here.
    path = P.decoded(F.col("_metadata.file_path"))
    table = scanned.withColumns({"task": F.regexp_extract(path, "task=([^/]*)", 1), "model": F.regexp_extract(path, "model=([^/]*)", 1)})
    out = scratch_path(v.spark, "leaderboard_table")
    table.write.partitionBy("model").parquet(out)
    return v.spark.read.parquet(out).groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"), F.count("acc").alias("n_acc"))


@query("a3_file_discovery", "SELECT path FROM file_paths WHERE path NOT LIKE '%error%' AND NOT ends_with(path, '.pkl')")
def _(v):
    return B.drop_suffix(B.data_files(v.file_paths, without="error"), ".pkl").select("path")


_STAMP_SQL = r"20\d{2}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}(?:\.\d+)?"


@query(
    "a4_latest_per_base",
    f"""WITH parsed AS (SELECT path, regexp_extract(path, '{_STAMP_SQL}') AS stamp, regexp_replace(path, '[_\\-.]?{_STAMP_SQL}', '') AS base FROM file_paths)
    SELECT base, nullif(stamp, '') AS stamp, path FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY stamp DESC, path) AS r FROM parsed) WHERE r = 1""",
)
def _(v):
    return B.latest_per_base(v.file_paths)


@query("h10_stamp_search", f"SELECT event_id, nullif(regexp_extract(path, '{_STAMP_SQL}'), '') AS stamp FROM file_paths")
def _(v):
    return v.file_paths.select("event_id", P.stamp(F.col("path")).alias("stamp"))


@query(
    "b8_path_columns",
    """SELECT event_id, 'u' || user_id AS model, event_type AS task, strftime(ts, '%Y-%m-%dT%H-%M-%S.%f') AS stamp FROM events""",
)
def _(v):
    path = F.col("path")
    return v.file_paths.select(
        "event_id", P.parent_folder(path).alias("model"), P.sample_file_task(path).alias("task"), P.sample_file_stamp(path).alias("stamp")
    )


_CATALOGUE = """cat AS (SELECT DISTINCT source || '/' || lang AS fullname, n_chars % 2 = 0 AS official FROM documents),
    wanted AS (SELECT fullname, 'hub/' || split_part(fullname, '/', 1) || '__' || split_part(fullname, '/', 2) || '-details' AS id FROM cat WHERE official),
    listing AS (SELECT DISTINCT 'hub/' || source || '__' || lang || CASE WHEN n_chars % 3 = 0 THEN '-details' ELSE '-other' END AS id FROM documents WHERE lang <> 'de')"""


def _catalogue(v):
    docs = v.table("documents")
    catalogue = docs.selectExpr("concat(source, '/', lang) AS fullname", "n_chars % 2 = 0 AS official").distinct()
    listing = docs.where("lang <> 'de'").selectExpr(
        "concat('hub/', source, '__', lang, CASE WHEN n_chars % 3 = 0 THEN '-details' ELSE '-other' END) AS id"
    ).distinct()
    return B.catalogue_gate(catalogue, listing, "hub/")


@query("a5_catalogue_found", f"WITH {_CATALOGUE} SELECT * FROM wanted WHERE id IN (SELECT id FROM listing WHERE ends_with(id, '-details'))")
def _(v):
    return _catalogue(v)[0]


@query("a5_catalogue_missed", f"WITH {_CATALOGUE} SELECT * FROM wanted WHERE id NOT IN (SELECT id FROM listing WHERE ends_with(id, '-details'))")
def _(v):
    return _catalogue(v)[1]


_SHEET = """SELECT instance_id, model, task, predicted_text, stats_f1_score, CAST(stats_exact_match AS INT) AS label FROM run_rows"""


def _sheet_path(v):
    path = scratch_path(v.spark, "sheet")
    rows = v.run_rows.select(
        "instance_id", "model", "task", "predicted_text", "references", F.concat("task", F.lit('\n"quoted", '), "model").alias("reference_text"),
        "stats_bleu_4", "stats_f1_score", *[F.lit(None).cast("int").alias(c) for c in ("Vee", "Eee", "Ven", "Een")],
        F.col("stats_exact_match").cast("int").alias("label"),
    )
    T.write_sheet(rows, path)
    return path


@query("a6_labelled_sheet_scan", _SHEET)
def _(v):
    return T.read_sheet(v.spark, _sheet_path(v)).select("instance_id", "model", "task", "predicted_text", "stats_f1_score", "label")


@query("a7_sheet_sink", """SELECT task, count(*) AS n, CAST(count(DISTINCT task || chr(10) || '"quoted", ' || model) AS BIGINT) AS n_texts FROM run_rows GROUP BY 1""")
def _(v):
    sheet = T.read_sheet(v.spark, _sheet_path(v))
    return sheet.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("reference_text").alias("n_texts"))


@query("a8_model_table", "SELECT row_id, model, logit, correct FROM eval_long WHERE model = 'model_4'")
def _(v):
    path = scratch_path(v.spark, "models")
    S.write_per_model(v.eval_long.withColumnRenamed("model", "request_model"), path)
    return S.read_model(v.spark, path, "model_4").select("row_id", "model", "logit", "correct")


@query("a9_prediction_store", "SELECT model, run, epoch, count(*) AS n, round(avg(logit), 6) AS mean_logit FROM predictions GROUP BY ALL")
def _(v):
    path = scratch_path(v.spark, "predictions")
    T.write_predictions(v.predictions, path)
    stored = v.spark.read.parquet(path)
    return stored.groupBy("model", "run", "epoch").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("logit")).alias("mean_logit"))


_PRED_PATH = "concat('results/rejectors/', model, '/', coalesce(similarity, concat(CAST(f1 AS {t}), '_', CAST(bleu AS {t}))), '/', CAST(run AS {t}), '/logits_epoch_', CAST(epoch AS {t}), '.npy')"


@query("a9_prediction_keys", "SELECT DISTINCT model, f1, bleu, similarity, run, epoch FROM predictions")
def _(v):
    paths = v.predictions.selectExpr(f"{_PRED_PATH.format(t='STRING')} AS path").distinct()
    keys = T.prediction_keys(F.col("path"))
    return paths.select(*[c.alias(n) for n, c in keys.items()])


@query("a11_added_columns", "SELECT row_id, model, task, CAST(stats_exact_match = 1 AS INT) AS flag FROM answers")
def _(v):
    extended = v.answers.withColumn("flag", (F.col("stats_exact_match") == 1).cast("int"))
    return T.rewritten(extended).select("row_id", "model", "task", "flag")


@query("a12_wide_matrix_scan", "SELECT sample_id, model, correct FROM correct")
def _(v):
    path = scratch_path(v.spark, "wide")
    R.merge_model_tables(v.correct, ["sample_id"], MODELS).write.parquet(path)
    return T.read_wide_matrix(v.spark, path, ["sample_id"])


@query("b3_rename_columns", "SELECT row_id AS sample_id, model AS llm, logit AS score FROM eval_long")
def _(v):
    return v.eval_long.withColumnsRenamed({"row_id": "sample_id", "model": "llm", "logit": "score"}).select("sample_id", "llm", "score")


@query("b4_model_names", "SELECT DISTINCT source || '__' || upper(lang) || '/X' AS raw, replace(replace(lower(source || '__' || upper(lang) || '/X'), '__', '_'), '/', '_') AS name FROM documents")
def _(v):
    raw = v.table("documents").select(F.concat("source", F.lit("__"), F.upper("lang"), F.lit("/X")).alias("raw")).distinct()
    return raw.withColumn("name", R.normalise_model_name(F.col("raw")))


@query("b4_name_collisions", """SELECT lower(source) AS name, count(*) AS n_raw FROM (SELECT DISTINCT CASE WHEN n_chars % 2 = 0 THEN upper(source) ELSE source END AS source FROM documents)
    GROUP BY 1 HAVING count(*) > 1""")
def _(v):
    raw = v.table("documents").selectExpr("CASE WHEN n_chars % 2 = 0 THEN upper(source) ELSE source END AS model")
    return R.name_collisions(raw)


@query("b5_pruned_columns", "SELECT doc_id, lang FROM documents")
def _(v):
    return v.table("documents").select("doc_id", "lang")


@query("b6_membership", "SELECT row_id, task FROM answers WHERE task IN ('narrative_qa', 'natural_qa', 'wmt_14') AND model NOT IN ('model_0', 'model_9')")
def _(v):
    kept = v.answers.where(F.col("task").isin("narrative_qa", "natural_qa", "wmt_14") & ~F.col("model").isin("model_0", "model_9"))
    return kept.select("row_id", "task")


@query("b7_missing_filters", "SELECT row_id, model FROM answers WHERE stats_f1_score IS NOT NULL AND NOT isnan(stats_f1_score) AND stats_bleu_4 IS NOT NULL")
def _(v):
    return v.answers.na.drop(subset=["stats_f1_score", "stats_bleu_4"]).select("row_id", "model")


@query("b9_constant_column", "SELECT row_id AS sample_id, 'leaderboard' AS eval_name FROM eval_long")
def _(v):
    return v.eval_long.select(F.col("row_id").alias("sample_id"), F.lit("leaderboard").alias("eval_name"))


@query("b10_casts", "SELECT event_id, try_cast(acc AS DOUBLE) AS acc, CAST(event_id AS INT) AS epoch FROM docs_json")
def _(v):
    return v.docs_json.select("event_id", F.col("acc").try_cast("double").alias("acc"), F.col("event_id").cast("int").alias("epoch"))


@query(
    "b11_model_columns",
    "SELECT model, count(correct) AS n, CAST(sum(correct) AS BIGINT) AS n_right, round(avg(correct), 6) AS accuracy FROM correct GROUP BY 1",
)
def _(v):
    """The columns of a wide table that are models, each with its own cells."""
    wide = R.merge_model_tables(v.correct, ["sample_id"], MODELS)
    cells = R.to_long(wide, ["sample_id"]).groupBy("model")
    return cells.agg(F.count("correct").alias("n"), F.sum("correct").alias("n_right"), F.round(F.avg("correct"), 6).alias("accuracy"))


@query(
    "b13_long_to_wide",
    "SELECT sample_id, " + ", ".join(f"max(correct) FILTER (model = '{m}') AS {m}" for m in MODELS) + " FROM correct GROUP BY 1",
)
def _(v):
    return R.to_wide(v.correct, ["sample_id"], "model", "correct", MODELS)


@query("b15_fill_zero", "SELECT sample_id, model, coalesce(correct, 0) AS correct FROM correct")
def _(v):
    return v.correct.na.fill(0, subset=["correct"])


@query("b17_id_renames", "SELECT doc_id AS sample_id, text AS prompt, n_chars AS model_1 FROM documents")
def _(v):
    return v.table("documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("prompt"), F.col("n_chars").alias("model_1"))
