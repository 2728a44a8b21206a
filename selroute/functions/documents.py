"""Raw task documents (JSON of an open schema): key signature, rule dispatch and prompt text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIST_SEPARATOR = " | "

# Which document keys identify a task, which of them make up the prompt, and which metric
# tells whether the answer was right.
_EXPERT_MCQ_KEYS = [
    "Pre-Revision Question", "Pre-Revision Correct Answer", "Pre-Revision Incorrect Answer 1",
    "Pre-Revision Incorrect Answer 2", "Pre-Revision Incorrect Answer 3", "Pre-Revision Explanation",
    "Self-reported question-writing time (minutes)", "Question", "Correct Answer", "Incorrect Answer 1",
    "Incorrect Answer 2", "Incorrect Answer 3", "Explanation", "Revision Comments (from Question Writer)",
    "Subdomain", "Writer's Difficulty Estimate", "Extra Revised Question", "Extra Revised Explanation",
    "Extra Revised Correct Answer", "Extra Revised Incorrect Answer 1", "Extra Revised Incorrect Answer 2",
    "Extra Revised Incorrect Answer 3", "Non-Expert Validator Accuracy", "Majority Non-Expert Vals Incorrect",
    "Expert Validator Accuracy", "Record ID", "High-level domain", "Question Writer", "Feedback_EV_1",
    "Validator Revision Suggestion_EV_1", "Is First Validation_EV_1", "Post hoc agreement_EV_1",
    "Sufficient Expertise?_EV_1", "Understand the question?_EV_1", "Question Difficulty_EV_1",
    "Validator Answered Correctly_EV_1", "Self-reported time (minutes)_EV_1", "Probability Correct_EV_1",
    "Manual Correctness Adjustment_EV_1", "Expert Validator_EV_1", "Feedback_EV_2",
    "Validator Revision Suggestion_EV_2", "Is First Validation_EV_2", "Post hoc agreement_EV_2",
    "Sufficient Expertise?_EV_2", "Understand the question?_EV_2", "Question Difficulty_EV_2",
    "Validator Answered Correctly_EV_2", "Self-reported time (minutes)_EV_2", "Probability Correct_EV_2",
    "Manual Correctness Adjustment_EV_2", "Expert Validator_EV_2", "Feedback_NEV_1",
    "Validator Answered Correctly_NEV_1", "Explanation_NEV_1", "Self-reported time (minutes)_NEV_1",
    "Websites visited_NEV_1", "Probability Correct_NEV_1", "Manual Correctness Adjustment_NEV_1",
    "Non-Expert Validator_NEV_1", "Feedback_NEV_2", "Validator Answered Correctly_NEV_2", "Explanation_NEV_2",
    "Self-reported time (minutes)_NEV_2", "Websites visited_NEV_2", "Probability Correct_NEV_2",
    "Manual Correctness Adjustment_NEV_2", "Non-Expert Validator_NEV_2", "Feedback_NEV_3",
    "Validator Answered Correctly_NEV_3", "Explanation_NEV_3", "Self-reported time (minutes)_NEV_3",
    "Websites visited_NEV_3", "Probability Correct_NEV_3", "Manual Correctness Adjustment_NEV_3",
    "Non-Expert Validator_NEV_3", "Expert Validator Disagreement Category", "Canary String", "choice1", "choice2",
    "choice3", "choice4", "answer",
]
DOCUMENT_RULES = [
    (["level", "type", "problem", "solution", "answer"], ["problem"], "exact_match"),
    (["input", "target"], ["input"], "acc_norm"),
    (["question", "answer"], ["question"], "exact_match"),
    (_EXPERT_MCQ_KEYS, ["Question", "choice1", "choice2", "choice3", "choice4"], "acc_norm"),
    (
        ["question_id", "question", "options", "answer", "answer_index", "cot_content", "category", "src"],
        ["question", "options"],
        "acc",
    ),
    (["key", "prompt", "instruction_id_list", "kwargs"], ["prompt"], "prompt_level_loose_acc"),
    (
        ["narrative", "question", "choices", "answer_index", "answer_choice"],
        ["narrative", "question", "choices"],
        "acc_norm",
    ),
    (
        [
            "section_id", "passage", "question", "query_id", "id", "answers", "answer.number", "answer.date.day",
            "answer.date.month", "answer.date.year", "answer.spans", "answer.worker_id", "answer.hit_id",
            "validated_answers.number", "validated_answers.date", "validated_answers.spans",
            "validated_answers.worker_id", "validated_answers.hit_id",
        ],
        ["passage", "question"],
        "em",
    ),
    (["id", "question", "answerKey", "choices.text", "choices.label"], ["question", "choices.text"], "acc"),
]


def signature_of(keys: list[str]) -> str:
    return "\x1f".join(sorted(keys))


def rule_table(spark: SparkSession) -> DataFrame:
    """(signature, fields, metric), one row per known document schema."""
    rows = [
        F.struct(
            F.lit(signature_of(keys)).alias("signature"),
            F.array(*[F.lit(f) for f in fields]).alias("fields"),
            F.lit(metric).alias("metric"),
        )
        for keys, fields, metric in DOCUMENT_RULES
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


class _Invalid(ValueError):
    """Text that is JSON to a lenient reader only."""


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Invalid("a key occurs twice")
    return out


def _no_number(name: str) -> None:
    raise _Invalid(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_no_number)


def leaf_names(doc: str | None) -> list[str]:
    """Sorted dotted names of the leaves of a JSON object; lists are leaves, empty objects have none. Levels are walked as the
    document has them. A text that is no JSON object, or that repeats a key, has no leaves."""
    try:
        value = _DECODER.decode(doc.strip(" \t\n\r")) if doc else None
    except (ValueError, RecursionError):
        value = None
    found, todo = [], [("", value)] if isinstance(value, dict) else []
    while todo:
        name, node = todo.pop()
        for key, inner in node.items():
            if isinstance(inner, dict):
                todo.append((f"{name}{key}.", inner))
            else:
                found.append(name + key)
    return sorted(found)


def leaf_keys(doc_json: Column) -> Column:
    """``leaf_names`` of a column of JSON texts: one expression of constant size, whatever the depth of any document."""

    @F.arrow_udf("array<string>")
    def names(docs: pa.Array) -> pa.Array:
        return pa.array([leaf_names(d) for d in docs.to_pylist()], pa.list_(pa.string()))

    return names(doc_json)


def key_signature(doc_json: Column) -> Column:
    return F.array_join(leaf_keys(doc_json), "\x1f")


def _scalar_text(value: Column, missing: str) -> Column:
    """Text of one JSON value: booleans capitalised, objects and lists as compact JSON."""
    flag = F.try_variant_get(value, "$", "boolean")
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(missing))
        .when(kind == "BOOLEAN", F.when(flag, "True").otherwise("False"))
        .otherwise(value.cast("string"))
    )


def stringify(value: Column) -> Column:
    """Lists joined by a bar, missing as empty text, anything nested as JSON."""
    items = F.try_variant_get(value, "$", "array<variant>")
    listed = F.array_join(F.transform(items, lambda x: _scalar_text(x, "None")), LIST_SEPARATOR)
    return F.when(items.isNotNull(), listed).otherwise(_scalar_text(value, ""))


def field_value(doc: Column, field: Column) -> Column:
    """Look a field up; a dotted field goes one level down."""
    top = F.try_variant_get(doc, "$", "map<string,variant>")
    parts = F.split(field, r"\.")
    inner = F.try_variant_get(F.element_at(top, F.get(parts, 0)), "$", "map<string,variant>")
    return F.when(F.size(parts) > 1, F.element_at(inner, F.get(parts, 1))).otherwise(F.element_at(top, field))


def prompt_text(doc: Column, fields: Column) -> Column:
    """``field: value`` chunks joined by blanks; a field without value keeps its name."""
    return F.array_join(
        F.transform(fields, lambda f: F.concat(f, F.lit(": "), stringify(field_value(doc, f)))), " "
    )
