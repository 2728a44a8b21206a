"""Dataset building: joins, set operations, deduplication, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from selroute.operators import reshape as R
from selroute.operators import splits as S
from selroute.operators.ordering import seeded_rank
from selroute.plans.registry import query, r6, rounded
from selroute.plans.views import MODELS

_PRESENT = "present AS (SELECT row_id AS sample_id, model FROM eval_long WHERE correct IS NOT NULL)"
_SHARED = f"{_PRESENT}, shared AS (SELECT sample_id FROM present GROUP BY 1 HAVING count(DISTINCT model) = {len(MODELS)})"


def _present(v):
    return v.eval_long.where("correct IS NOT NULL").select(F.col("row_id").alias("sample_id"), "model", "correct")


@query("g2_shared_ids", f"WITH {_SHARED} SELECT sample_id FROM shared")
def _(v):
    return S.shared_by_all(_present(v), "sample_id")


@query(
    "c2_model_table_merge",
    "SELECT sample_id, prompt, " + ", ".join(f"max(correct) FILTER (model = '{m}') AS {m}" for m in MODELS)
    + " FROM correct JOIN (SELECT doc_id AS sample_id, text AS prompt FROM documents) USING (sample_id) WHERE correct IS NOT NULL GROUP BY ALL",
)
def _(v):
    prompts = v.table("documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("prompt"))
    return R.merge_model_tables(_present(v), ["sample_id"], MODELS).join(prompts, "sample_id")


@query("c4_shared_test", f"WITH {_SHARED} SELECT sample_id, model FROM present WHERE sample_id IN (FROM shared)")
def _(v):
    return S.shared_split(_present(v).select("sample_id", "model"))[1]


@query("c4_unshared_train", f"WITH {_SHARED} SELECT sample_id, model FROM present WHERE sample_id NOT IN (FROM shared)")
def _(v):
    return S.shared_split(_present(v).select("sample_id", "model"))[0]


_TASK_SAMPLE = """picked AS (SELECT task, row_id FROM (SELECT task, row_id, row_number() OVER (PARTITION BY task ORDER BY md5('1-' || row_id), row_id) AS r
    FROM (SELECT DISTINCT task, row_id FROM answers)) WHERE r <= 30)"""


@query("f4_sample_per_task", f"WITH {_TASK_SAMPLE} SELECT * FROM picked")
def _(v):
    return S.sample_per_group(v.answers.select("task", "row_id").distinct(), ["task"], 1, ["row_id"], 30)


@query("c5_sampled_membership", f"WITH {_TASK_SAMPLE} SELECT a.row_id, a.model, a.task FROM answers a WHERE a.row_id IN (SELECT row_id FROM picked)")
def _(v):
    ids = S.sample_per_group(v.answers.select("task", "row_id").distinct(), ["task"], 1, ["row_id"], 30)
    return v.answers.join(ids.select("row_id"), "row_id", "left_semi").select("row_id", "model", "task")


@query("d5_ids_of_all_models", f"WITH {_PRESENT} SELECT sample_id, count(*) AS n FROM present GROUP BY 1 HAVING count(*) = 10")
def _(v):
    return _present(v).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n = 10")


@query("d8_missing_rate", "SELECT sample_id, round(avg(CAST(correct IS NULL AS INT)), 6) AS missing_rate FROM correct GROUP BY 1")
def _(v):
    return rounded(S.missing_rates(v.correct).select("sample_id", "missing_rate"), "missing_rate")


@query(
    "e3_keep_first",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
)
def _(v):
    once = S.keep_first(v.table("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return once.select("user_id", "event_type", "event_id", "value")


@query(
    "e6_position_split",
    """SELECT doc_id, CASE WHEN r <= (10 * n + 11) // 12 THEN 'train' ELSE 'test' END AS part FROM (
      SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)""",
)
def _(v):
    """Ten parts of twelve train, two test: the proportion of the original positions, over all documents."""
    docs = v.table("documents").select("doc_id")
    n = docs.count()
    train = (10 * n + 11) // 12
    return S.position_split(docs, 42, ["doc_id"], train, n - train)


_BANK_SQL = """SELECT sample_id, CASE WHEN r <= floor(n * 0.05) THEN 'bank' ELSE 'train' END AS part FROM (
      SELECT sample_id, row_number() OVER (ORDER BY gaps, md5('bank-' || sample_id), sample_id) AS r, count(*) OVER () AS n
      FROM (SELECT sample_id, count(*) FILTER (correct IS NULL) AS gaps FROM correct GROUP BY 1))"""


@query("e7_bank_split", _BANK_SQL)
def _(v):
    return S.bank_split(v.correct)


@query("e7_bank_split_cut", _BANK_SQL)
def _(v):
    """The same with items of equally many gaps cut into buckets."""
    return S.bank_split(v.correct, rows_per_bucket=50)


@query("f3_seeded_shuffle", "SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) AS BIGINT) AS place FROM documents")
def _(v):
    return seeded_rank(v.table("documents").select("doc_id"), (), 42, ["doc_id"], rank="place")


@query(
    "f6_fraction_split",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) <= ceil(0.3 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part FROM documents""",
)
def _(v):
    return S.fraction_split(v.table("documents").select("doc_id"), 42, ["doc_id"], 0.3)


@query(
    "g1_union_by_name",
    """SELECT doc_id AS id, text, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT page_id, html, NULL, url FROM pages""",
)
def _(v):
    docs = v.table("documents").select(F.col("doc_id").alias("id"), "text", "lang")
    pages = v.table("pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), "url")
    return R.union_all([docs, pages])


_TRANSLATED = """tr AS (SELECT *, array_to_string(list_transform(refs, lambda r: r.output.text), chr(10) || '---' || chr(10)) AS reference_text FROM run_rows),
    common AS (SELECT reference_text FROM tr WHERE task = 'wmt_14' GROUP BY 1 HAVING count(DISTINCT model) = 10)"""


@query("g3_shared_reference_texts", f"WITH {_TRANSLATED} SELECT row_id, reference_text FROM tr WHERE task = 'wmt_14' AND reference_text IN (FROM common)")
def _(v):
    from selroute.functions.text import reference_texts

    rows = v.run_rows.where("task = 'wmt_14'").withColumn("reference_text", reference_texts(F.col("references")))
    common = S.shared_by_all(rows, "reference_text")
    return rows.join(common, "reference_text", "left_semi").select("row_id", "reference_text")


@query("g4_plain_union", "SELECT row_id, task FROM run_rows WHERE task = 'math' UNION ALL SELECT row_id, task FROM run_rows WHERE task = 'wmt_14'")
def _(v):
    rows = v.run_rows.select("row_id", "task")
    return rows.where("task = 'math'").unionByName(rows.where("task = 'wmt_14'"))


@query("g5_set_difference", f"WITH {_SHARED} SELECT doc_id AS sample_id FROM documents EXCEPT SELECT sample_id FROM shared")
def _(v):
    everything = v.table("documents").select(F.col("doc_id").alias("sample_id"))
    return everything.join(S.shared_by_all(_present(v), "sample_id"), "sample_id", "left_anti")


@query(
    "j12_annotation_sample",
    f"""WITH {_TRANSLATED}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, instance_id ORDER BY row_order) AS r
        FROM tr WHERE task IN ('narrative_qa', 'natural_qa')) WHERE r = 1),
    ids AS (SELECT task, instance_id, row_number() OVER (PARTITION BY task ORDER BY md5('1-' || instance_id), instance_id) AS k
        FROM (SELECT task, instance_id FROM once GROUP BY ALL HAVING count(DISTINCT model) = 10)),
    texts AS (SELECT reference_text, row_number() OVER (ORDER BY md5('1-' || reference_text), reference_text) AS k FROM common)
    SELECT row_id, model, task, instance_id, reference_text FROM once WHERE instance_id IN (SELECT instance_id FROM ids WHERE k <= 30)
    UNION ALL SELECT row_id, model, task, instance_id, reference_text FROM tr WHERE task = 'wmt_14' AND reference_text IN (SELECT reference_text FROM texts WHERE k <= 30)""",
)
def _(v):
    return S.annotation_sample(v.run_rows).select("row_id", "model", "task", "instance_id", "reference_text")


@query(
    "n4_shared_matrix",
    f"""WITH {_SHARED}, full_rows AS (SELECT e.row_id AS sample_id, e.model, e.correct, CASE WHEN s.sample_id IS NOT NULL THEN 'test' ELSE 'train' END AS part
      FROM eval_long e LEFT JOIN shared s ON s.sample_id = e.row_id WHERE e.correct IS NOT NULL)
    SELECT part, sample_id, 'leaderboard' AS eval_name, {", ".join(f"max(correct) FILTER (model = '{m}') AS {m}" for m in MODELS)} FROM full_rows GROUP BY ALL""",
)
def _(v):
    rows = _present(v).withColumn("row_order", F.col("sample_id"))
    # every row twice, so that keep-first has something to do
    doubled = rows.withColumn("row_order", F.explode(F.array(F.col("row_order"), F.col("row_order") + 1)))
    long = S.shared_matrix(doubled, "leaderboard")
    return R.merge_model_tables(long, ["part", "sample_id", "eval_name"], MODELS)


@query(
    "n5_filtered_matrix",
    """WITH kept AS (SELECT doc_id AS sample_id, source AS eval_name FROM documents WHERE source NOT IN ('src0', 'src7', 'src13')),
    split AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42-' || sample_id), sample_id) <= ceil(0.3 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part FROM kept)
    SELECT sample_id, eval_name, part, 'org_' || model AS model, correct FROM split JOIN correct USING (sample_id)""",
)
def _(v):
    kept = v.table("documents").where(~F.col("source").isin("src0", "src7", "src13")).select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("eval_name")
    )
    split = S.fraction_split(kept, 42, ["sample_id"], 0.3)
    raw = v.correct.withColumn("model", R.normalise_model_name(F.concat(F.lit("Org/"), F.col("model"))))
    return split.join(raw, "sample_id").select("sample_id", "eval_name", "part", "model", "correct")
