"""Fixed schemas of the inputs, so that no reader has to infer one."""

from pyspark.sql import types as T

REFERENCE = T.StructType(
    [
        T.StructField("output", T.StructType([T.StructField("text", T.StringType())])),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

# The statistics a run reports per answer.
STATS = (
    "exact_match",
    "quasi_exact_match",
    "f1_score",
    "bleu_4",
    "final_number_exact_match",
    "math_equiv_chain_of_thought",
)

PREDICTIONS = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("predicted_text", T.StringType()),
        T.StructField("stats", T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])),
    ]
)
REQUESTS = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("request", T.StructType([T.StructField("model", T.StringType()), T.StructField("prompt", T.StringType())])),
    ]
)
INSTANCES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("input", T.StructType([T.StructField("text", T.StringType())])),
        T.StructField("references", T.ArrayType(REFERENCE)),
    ]
)
# ``doc`` stays JSON text: its schema differs per task and must not be merged.
SAMPLES = T.StructType(
    [
        T.StructField("doc", T.StringType()),
        T.StructField("doc_hash", T.StringType()),
        T.StructField("exact_match", T.StringType()),
        T.StructField("acc", T.StringType()),
        T.StructField("acc_norm", T.StringType()),
        T.StructField("em", T.StringType()),
        T.StructField("prompt_level_loose_acc", T.StringType()),
    ]
)
LABELLED_SHEET = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("predicted_text", T.StringType()),
        T.StructField("references", T.StringType()),
        T.StructField("reference_text", T.StringType()),
        T.StructField("stats_bleu_4", T.DoubleType()),
        T.StructField("stats_f1_score", T.DoubleType()),
        T.StructField("Vee", T.IntegerType()),
        T.StructField("Eee", T.IntegerType()),
        T.StructField("Ven", T.IntegerType()),
        T.StructField("Een", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
    ]
)
