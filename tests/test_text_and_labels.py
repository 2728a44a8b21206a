"""Text scoring, labelling rules, entailment decisions and document dispatch."""

import collections
import math
import re
import string

import pandas as pd
import pytest
from pyspark.sql import functions as F

from selroute.functions import documents as D
from selroute.functions import paths as P
from selroute.functions import text as T
from selroute.functions.scores import histogram_slot, to_binary
from selroute.operators import entailment as N
from selroute.operators import labels as L
from selroute.operators import overlap as O

TEXTS = ["", "The cat!", "a the an", "ançeau the chat", "the—cat “the dog”", "An apple, a day;  keeps the doctor away", "theater an_the x"]


def plain_tokens(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return re.sub(r"\b(a|an|the)\b", " ", s).split()


def test_answer_tokens_match_unicode_word_boundaries(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.answer_tokens(F.col("t")).alias("w"))
    for row in df.collect():
        assert row.w == plain_tokens(row.t), row.t


def plain_f1(pred, ref):
    p, r = plain_tokens(pred), plain_tokens(ref)
    if not p or not r:
        return 1.0 if not p and not r else 0.0
    same = sum((collections.Counter(p) & collections.Counter(r)).values())
    return 0.0 if same == 0 else 2 * same / (len(p) + len(r))


def test_token_f1(spark):
    pairs = [(i, a, b) for i, (a, b) in enumerate((x, y) for x in TEXTS for y in TEXTS)] + [(999, None, "x")]
    df = spark.createDataFrame(pairs, "row_id long, pred string, ref string")
    got = {r.row_id: r.f1_complete for r in O.score_token_f1(df, "row_id").collect()}
    assert 999 not in got and len(got) == len(pairs) - 1
    for i, a, b in pairs[:-1]:
        assert got[i] == pytest.approx(plain_f1(a, b)), (a, b)


def plain_bleu(pred, ref):
    """Sentence BLEU-4 on blank-separated tokens, straight from the published definition."""
    p, r = pred.split(), ref.split()
    logs, misses, any_match = [], 0, False
    for n in range(1, 5):
        grams = collections.Counter(tuple(p[i : i + n]) for i in range(len(p) - n + 1))
        wanted = collections.Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        total, same = sum(grams.values()), sum((grams & wanted).values())
        if not total:
            break
        any_match = any_match or same > 0
        misses += same == 0
        logs.append(math.log(same / total if same else 1 / (2**misses * total)))
    if not any_match:
        return 0.0
    return (1.0 if len(p) >= len(r) else math.exp(1 - len(r) / len(p))) * math.exp(sum(logs) / len(logs))


def test_bleu(spark):
    texts = ["the cat sat on the mat", "the cat", "dog", "on the mat the cat sat", "the cat sat on the mat today again", ""]
    pairs = [(i, a, b) for i, (a, b) in enumerate((x, y) for x in texts for y in texts)]
    df = spark.createDataFrame(pairs, "row_id long, pred string, ref string")
    got = {r.row_id: r.bleu_complete for r in O.score_bleu4(df, "row_id").collect()}
    for i, a, b in pairs:
        assert got[i] == pytest.approx(plain_bleu(a, b)), (a, b)


def test_mteval_tokens(spark):
    cases = {
        "Hello, world!": ["Hello", ",", "world", "!"],
        "It costs 3.50 or 1,000-2": ["It", "costs", "3.50", "or", "1,000", "-", "2"],
        "a &quot;b&quot; c-\nd": ["a", '"', "b", '"', "cd"],
        "don't U.S.": ["don't", "U", ".", "S", "."],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.mteval_tokens(F.col("t")).alias("w"))
    assert {r.t: r.w for r in df.collect()} == {**cases, 'a &quot;b&quot; c-\nd': ["a", '"', "b", '"', "cd"]}


def test_boxed_answer(spark):
    rows = [("so \\boxed{x{y}z} and \\boxed{q}",), ("none",), ("\\boxed{}",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.boxed_answer(F.col("t"))).collect()]
    assert got == ["x{y}z", None, ""]


REFS = "array<struct<output: struct<text: string>, tags: array<string>>>"


def test_references(spark):
    rows = [([(("x",), ["correct"]), (("y",), ["correct"]), (("z",), ["correct", "more"])],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"references {REFS}")
    got = df.select(
        T.correct_option(F.col("references")), T.reference_texts(F.col("references")), T.first_reference(F.col("references"))
    ).collect()
    assert [tuple(r) for r in got] == [("B", "x\n---\ny\n---\nz", "x"), ("", "", None), ("", "", None)]


def test_missing_metric_is_wrong_and_override_stays_missing(spark):
    rows = [("narrative_qa", None, 1), ("narrative_qa", float("nan"), None), ("narrative_qa", 0.6, 0), ("mystery", 0.9, 1)]
    df = spark.createDataFrame(rows, "task string, stats_f1_score double, Een int")
    assert [r.correct for r in L.threshold_label(df).collect()] == [0, 0, 1, None]
    assert [r.correct for r in L.threshold_label(df, override="Een").collect()] == [1, None, 0, None]
    assert [r.correct for r in L.threshold_label(df, f1=0.7).collect()] == [0, 0, 0, None]


def test_composite_rules(spark):
    df = spark.createDataFrame([(1, 0.3, 0.05), (2, None, 0.95), (3, None, None)], "id int, bleu_complete double, f1_complete double")
    rules = L.composite_rules(df, ["id"])
    assert rules.count() == 3 * 90 and rules.select("rule").distinct().count() == 90
    got = {(r.id, r.rule): r.value for r in rules.collect()}
    assert got[1, "or_0.3_0.9"] == 1 and got[1, "and_0.3_0.1"] == 0
    assert got[2, "or_0.05_0.9"] == 1 and got[2, "and_0.05_0.1"] == 0 and got[3, "or_0.05_0.1"] == 0
    for (i, rule), value in got.items():
        if rule.startswith("and"):
            assert got[i, "or" + rule[3:]] >= value
    blends = {(r.id, r.rule): r.value for r in L.blends(df, ["id"]).collect()}
    assert blends[1, "alpha_0.1"] == pytest.approx(0.1 * 0.05 + 0.9 * 0.3)
    assert blends[2, "alpha_0.5"] is None and blends[2, "combo_max"] == 0.95 and blends[2, "combo_min"] == 0.95


def test_to_binary(spark):
    values = [" True ", "false", "1.0", "0", "nan", None, "word"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    assert [r[0] for r in df.select(to_binary(F.col("x"))).collect()] == [1, 0, 1, 0, None, None, 0]


def test_entailment_decisions(spark):
    e, n, c = "entailment", "neutral", "contradiction"
    cases = {1: [(e, e), (e, n)], 2: [(e, n), (c, e)], 3: [(e, e)]}
    rows = [(i, pos, d, ways[d]) for i, refs in cases.items() for pos, ways in enumerate(refs) for d in (0, 1)]
    labels = spark.createDataFrame(rows, "row_id int, ref_pos int, direction int, label string")
    base = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "row_id int")
    got = {r.row_id: tuple(r)[1:] for r in N.add_decisions(base, N.decisions(labels)).collect()}
    assert got == {1: (0, 1, 1, 1), 2: (0, 0, 0, 1), 3: (1, 1, 1, 1), 4: (None,) * 4}


def test_pair_scorer_runs_in_batches(spark):
    rows = [(1, "a cat", [(("a cat",), []), (("dog",), [])], 0.5, None), (2, "x", [(("x",), [])], None, None)]
    df = spark.createDataFrame(rows, f"row_id int, predicted_text string, references {REFS}, stats_f1_score double, stats_bleu_4 double")
    pairs = N.entailment_pairs(df)
    assert pairs.count() == 4  # the row without any overlap metric has no pairs

    def same(premise: pd.Series, hypothesis: pd.Series):
        return [[0.0, 1.0, 0.0] if a == b else [1.0, 0.0, 0.0] for a, b in zip(premise, hypothesis)]

    got = N.decisions(N.pair_labels(N.score_pairs(pairs, same))).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, 0, 1)]


def test_first_maximum_of_class_scores(spark):
    df = spark.createDataFrame([(1, 0, 0, [0.5, 0.5, 0.1])], "row_id int, ref_pos int, direction int, scores array<double>")
    assert N.pair_labels(df).first().label == "contradiction"


def test_document_rules(spark):
    expert = {k: "v" for k in D.DOCUMENT_RULES[3][0]}
    import json

    docs = [
        (1, json.dumps(expert)), (2, '{"question": null, "answer": "x"}'), (3, '{"zzz": 1}'), (4, "not json"),
        (5, '{"id": "1", "question": "q", "answerKey": "A", "choices": {"text": ["l", "r"], "label": ["A", "B"]}}'),
        (6, '{"input": true, "target": 1}'), (7, '{"narrative": "n", "question": "q", "choices": [null, true, 2], "answer_index": 0, "answer_choice": ""}'),
    ]
    df = spark.createDataFrame(docs, "id int, doc string")
    for name in ("exact_match", "acc_norm", "acc"):
        df = df.withColumn(name, F.lit("True"))
    known, rest = L.prepare_prompts(df)
    got = {r.id: (r.input, r.correctness, r.metric) for r in known.collect()}
    assert {r.id for r in rest.collect()} == {3, 4}
    assert got[1] == ("Question: v choice1: v choice2: v choice3: v choice4: v", 1, "acc_norm")
    assert got[2] == ("question: ", 1, "exact_match")
    assert got[5] == ("question: q choices.text: l | r", 1, "acc")
    assert got[6][0] == "input: True"
    assert got[7][0] == "narrative: n question: q choices: None | True | 2"


def test_paths(spark):
    rows = [
        ("m/samples_big_task_2024-01-02T03-04-05.678.jsonl", "m/samples_big_task.jsonl", "big_task", "2024-01-02T03-04-05.678"),
        ("m/plain.json", "m/plain.json", "", "plain"),
    ]
    df = spark.createDataFrame(rows, "path string, base string, task string, stamp string")
    c = F.col("path")
    for r in df.select("*", P.stampless(c).alias("b"), P.sample_file_task(c).alias("t"), P.sample_file_stamp(c).alias("s")).collect():
        assert (r.b, r.t, r.s) == (r.base, r.task, r.stamp)
    assert [r[0] for r in df.select(P.stamp(c)).collect()] == ["2024-01-02T03-04-05.678", None]


def test_histogram_slot_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "x double")
    assert [r[0] for r in df.select(histogram_slot(F.col("x"), F.lit(0.0), F.lit(1.0), 10)).collect()] == [0, 5, 9]


def test_signatures_of_documents_of_any_depth(spark):
    """A document of 200 levels beside flat ones: names are right and the plan is no larger than without it."""
    deep = '{"k":' * 200 + "1" + "}" * 200
    docs = [deep, '{"b":1,"a":{"x":[{"y":1}],"é":{}}}', "{}", "[1]", "no json", None, '{"a":1,"a":2}', ' {"a.b":null} ', '{"a":NaN}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")
    got = {r.i: r.k for r in df.select("i", D.leaf_keys(F.col("doc")).alias("k")).collect()}
    assert got[0] == [".".join(["k"] * 200)] and got[1] == ["a.x", "b"] and got[7] == ["a.b"]
    assert all(got[i] == [] for i in (2, 3, 4, 5, 6, 8))
    sizes = [len(L.dispatch_documents(part)._jdf.queryExecution().optimizedPlan().toString()) for part in (df, df.where("i > 0"))]
    assert abs(sizes[0] - sizes[1]) < 200
    assert D.leaf_names('{"k":' * 100_000) == []
