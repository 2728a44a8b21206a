"""Deduplication, shared-instance selection, seeded samples and train/test/bank splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selroute.functions.text import reference_texts
from selroute.operators.ordering import (
    ROWS_PER_BUCKET,
    TAKE_BUCKET_ROWS,
    attach,
    digest_running,
    first_per_group,
    seeded_digest,
    seeded_rank,
    seeded_take,
)
from selroute.session import durable

# The tasks that are annotated by hand.
ANNOTATED_TASKS = ("narrative_qa", "natural_qa", "wmt_14")
TRANSLATION_TASK = "wmt_14"


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in a declared order (``dropDuplicates`` would keep any row)."""
    return first_per_group(df, keys, order)


def shared_by_all(df: DataFrame, item: Sequence[str] | str, model: str = "model", among: Sequence[str] = ()) -> DataFrame:
    """Items that every model has, by one distinct count instead of a chain of intersections."""
    items = [item] if isinstance(item, str) else list(item)
    seen = df.select(*among, *items, model).distinct()
    wanted = seen.groupBy(*among).agg(F.count_distinct(model).alias("__models"))
    counts = seen.groupBy(*among, *items).agg(F.count(F.lit(1)).alias("__n"))
    return attach(counts, wanted, list(among), items).where("__n = __models").select(*among, *items)


def shared_split(df: DataFrame, item: str = "sample_id", model: str = "model") -> tuple[DataFrame, DataFrame]:
    """(train, test): test holds the rows of items shared by all models, train the rest."""
    shared = shared_by_all(df, item, model)
    return df.join(shared, item, "left_anti"), df.join(shared, item, "left_semi")


def shuffled(df: DataFrame, seed: int | str, ids: Sequence[str]) -> DataFrame:
    """The rows in seeded random order (a range-partitioned sort)."""
    return df.orderBy(seeded_digest(seed, *ids), *ids)


def position_split(df: DataFrame, seed: int | str, ids: Sequence[str], train: int, test: int, keys: Sequence[str] = ()) -> DataFrame:
    """First ``train`` rows of the seeded order are 'train', the next ``test`` rows 'test'; the rest is dropped."""
    ranked = seeded_rank(df, keys, seed, ids, rank="__rank")
    part = F.when(F.col("__rank") <= train, "train").otherwise("test")
    return ranked.where(F.col("__rank") <= train + test).withColumn("part", part).drop("__rank")


def fraction_split(
    df: DataFrame, seed: int | str, ids: Sequence[str], test_share: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``ceil(test_share * n)`` rows (of each group) become 'test', the others 'train'."""
    ranked = seeded_rank(df, keys, seed, ids, rank="__rank", size="__n")
    wanted = F.ceil(F.col("__n") * F.lit(float(test_share)))
    return ranked.withColumn("part", F.when(F.col("__rank") <= wanted, "test").otherwise("train")).drop("__rank", "__n")


def listed_draws(
    listed: DataFrame, seed: int, runs: int, row_id: str, groups: int, wanted: Sequence[Callable[[Column], Column]], rows_per_bucket: int = TAKE_BUCKET_ROWS
) -> DataFrame:
    """Seeded draws of every group in every run, the rows of an id in one list.

    ``listed``: (row_id, entries), a row per id; ``entries`` is a list of (group, label) with groups 0 to ``groups - 1``. Run r shuffles
    each group by the digests of seed + r, and ``wanted`` gives the positions (of a group's size) after which its order is cut, in
    rising order. Output: (row_id, drawn), ``drawn`` a list of (fit, label, part): fit is group x runs + run, part the number of cuts before.

    Counts per digest bucket tell in which bucket a cut lies; only that bucket is ranked. A cut is one place a group and run, so what
    the driver holds is as short as the list of classifiers, and every entry is compared with its cuts inside its own row.
    """
    spark, kind = listed.sparkSession, listed.schema[row_id].dataType
    buckets = max(1, -(-listed.count() // rows_per_bucket))
    prefix = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    spread = listed.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("digest", seeded_digest(F.col("run") + seed, row_id))
    spread = spread.withColumn("bucket", F.shiftrightunsigned(prefix * F.lit(buckets).cast("long"), 32))
    cells = spread.select("run", "bucket", F.explode("entries.group").alias("group")).groupBy("group", "run", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("group", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = cells.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy("group", "run"))})
    cuts = F.posexplode(F.array(*[w(F.col("total")).cast("long") for w in wanted])).alias("cut", "k")
    edges = sizes.select("group", "run", "bucket", "n", "upto", cuts)
    room = F.col("k") - F.col("upto") + F.col("n")
    edges = durable(edges.withColumn("room", room).where("room > 0 AND room <= n").select("group", "run", "bucket", "cut", "room"))

    near = spread.join(F.broadcast(edges.select("run", "bucket").distinct()), ["run", "bucket"], "left_semi")
    near = near.select(row_id, "run", "bucket", "digest", F.posexplode("entries").alias("at", "entry")).withColumn("group", F.col("entry.group"))
    order = Window.partitionBy("group", "run", "bucket", "cut").orderBy("digest", row_id, "at")
    last = near.join(F.broadcast(edges), ["group", "run", "bucket"]).withColumn("rank", F.row_number().over(order)).where("rank = room")
    found = {(r["cut"], r["group"] * runs + r["run"]): r for r in last.select("cut", "group", "run", "digest", row_id, "at").collect()}

    def place(cut: int, fit: int) -> Column:
        r = found.get((cut, fit))
        digest, spot, at = (r["digest"], r[row_id], r["at"]) if r else (None, None, None)  # without a cut all entries come before it
        return F.struct(F.lit(digest).cast("string").alias("digest"), F.struct(F.lit(spot).cast(kind).alias("id"), F.lit(at).cast("int").alias("at")).alias("spot"))

    places = [F.array(*[place(cut, fit) for fit in range(groups * runs)]) for cut in range(len(wanted))]

    def beyond(cut: int, fit: Column, digest: Column, at: Column) -> Column:
        edge = F.get(places[cut], fit)
        spot = F.struct(F.col(row_id).alias("id"), at.alias("at"))
        later = (digest > edge["digest"]) | ((digest == edge["digest"]) & (spot > edge["spot"]))
        return F.coalesce(later, F.lit(False)).cast("int")

    def entries_of(own: Column) -> Column:
        def drawn(entry: Column, at: Column) -> Column:
            fit = (entry["group"] * runs + own["run"]).cast("int")
            part = reduce(Column.__add__, [beyond(cut, fit, own["digest"], at) for cut in range(len(wanted))])
            return F.struct(fit.alias("fit"), entry["label"].alias("label"), part.alias("part"))

        return F.transform("entries", drawn)

    numbers = F.sequence(F.lit(0), F.lit(runs - 1))
    digests = F.transform(numbers, lambda run: F.struct(run.alias("run"), F.md5(F.concat_ws("-", (run + seed).cast("string"), F.col(row_id).cast("string"))).alias("digest")))
    return listed.select(row_id, F.flatten(F.transform(digests, entries_of)).alias("drawn"))


def sample_per_group(df: DataFrame, keys: Sequence[str], seed: int | str, ids: Sequence[str], k: int) -> DataFrame:
    """``k`` rows per group in the seeded order (all of them when the group is smaller)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    sized = attach(df, sizes, list(keys), list(ids)).withColumn("__take", F.lit(k))
    return seeded_take(sized, keys, seed, ids, "__take", "__size").drop("__take", "__size")


def class_counts(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Size of the smallest class per group."""
    groups = list(keys) or ["__all"]
    base = df if keys else df.withColumn("__all", F.lit(0))
    per_class = base.where(F.col(label).isNotNull()).groupBy(*groups, label).agg(F.count(F.lit(1)).alias("__n"))
    return per_class.groupBy(*groups).agg(F.min("__n").alias("min_count")).drop("__all")


def balanced_samples(
    df: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    seeds: Sequence[int],
    label: str = "label",
    rows_per_bucket: int = TAKE_BUCKET_ROWS,
) -> DataFrame:
    """For every seed, as many rows of each class as the smallest class of the group has.

    The seed is a column, so all repeats are one job.
    """
    base = df.where(F.col(label).isNotNull())
    # Class sizes do not depend on the seed, so they are counted before the rows are repeated per seed.
    per_class = base.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__size"))
    sizes = per_class.withColumn("__take", F.min("__size").over(Window.partitionBy(*keys)))  # one row per class
    sized = attach(base, sizes, [*keys, label], list(ids))
    seeded = sized.withColumn("seed", F.explode(F.sequence(F.lit(min(seeds)), F.lit(max(seeds)))))
    if len(seeds) != max(seeds) - min(seeds) + 1:
        seeded = seeded.where(F.col("seed").isin(list(seeds)))
    drawn = seeded_take(seeded, [*keys, "seed", label], F.col("seed"), ids, "__take", "__size", rows_per_bucket)
    return drawn.drop("__take", "__size")


def missing_rates(df: DataFrame, item: str = "sample_id", model: str = "model", value: str = "correct") -> DataFrame:
    """Share of models without a value per item, over the full item x model grid.

    ``df`` may leave missing cells out or carry them as NULL; both count as missing.
    """
    models = df.where(F.col(model).isNotNull()).agg(F.count_distinct(model).alias("__models"))
    per_item = df.groupBy(item).agg(F.count_distinct(F.when(F.col(value).isNotNull(), F.col(model))).alias("n_present"))
    return attach(per_item, models, [], [item]).select(
        item,
        (F.col("__models") - F.col("n_present")).alias("n_missing"),
        (F.lit(1.0) - F.col("n_present") / F.col("__models")).alias("missing_rate"),
    )


def bank_split(
    df: DataFrame,
    share: float = 0.05,
    item: str = "sample_id",
    model: str = "model",
    value: str = "correct",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(item, part): the most complete ``floor(share * n)`` items are 'bank', the others 'train'.

    Items with equally many missing cells are ordered by digest. The position is the number of items with
    fewer gaps plus the position among equals, so no task ever sorts all items.
    """
    rates = missing_rates(df, item, model, value).select(item, "n_missing")
    sizes = rates.groupBy("n_missing").agg(F.count(F.lit(1)).alias("__n"))
    # One row per possible number of gaps (at most the number of models + 1): a small running sum.
    offsets = sizes.select(
        "n_missing",
        F.expr("coalesce(sum(__n) over (order by n_missing rows between unbounded preceding and 1 preceding), 0)").alias("__ahead"),
        F.expr("sum(__n) over ()").alias("__all_items"),
    )
    ranked = digest_running(
        rates.withColumn("__digest", seeded_digest("bank", item)), ["n_missing"], "__digest", [item], {"__r": F.lit(1)}, rows_per_bucket
    )
    position = F.col("__ahead") + F.col("__r_upto")
    cut = F.floor(F.col("__all_items") * F.lit(float(share)))
    return attach(ranked, offsets, ["n_missing"], [item]).select(
        item, F.when(position <= cut, "bank").otherwise("train").alias("part")
    )


def shared_matrix(df: DataFrame, eval_name: str) -> DataFrame:
    """Long train/test matrix: items shared by all models are test; one row per (item, model), first kept."""
    shared = shared_by_all(df, "sample_id")
    once = keep_first(df, ["sample_id", "model"], [F.col("row_order")]).drop("row_order")
    flagged = once.join(shared.withColumn("__shared", F.lit(True)), "sample_id", "left")
    part = F.when(F.col("__shared"), "test").otherwise("train")
    return flagged.withColumn("part", part).withColumn("eval_name", F.lit(eval_name)).drop("__shared")


def annotation_sample(df: DataFrame, seed: int = 1, k: int = 30) -> DataFrame:
    """Rows to annotate by hand, for three tasks and all models.

    Question answering: ``k`` instances per task that every model answered, first row per model and
    instance. Translation: ``k`` reference texts that every model has, with all their rows.
    """
    base = df.where(F.col("task").isin(*ANNOTATED_TASKS)).withColumn("reference_text", reference_texts(F.col("references")))
    qa = base.where(F.col("task") != TRANSLATION_TASK)
    once = keep_first(qa, ["model", "instance_id"], [F.col("row_order")])
    # The number of models is taken over all annotated rows, per task.
    common = shared_by_all(once, "instance_id", among=("task",))
    ids = sample_per_group(common, ["task"], seed, ["instance_id"], k)
    questions = once.join(ids, ["task", "instance_id"], "left_semi")

    translation = base.where(F.col("task") == TRANSLATION_TASK)
    texts = sample_per_group(shared_by_all(translation, "reference_text", among=("task",)), ["task"], seed, ["reference_text"], k)
    translated = translation.join(texts, ["task", "reference_text"], "left_semi")
    return questions.unionByName(translated)
