"""Running totals and ranks whose groups may be far larger than one task.

A group of more than ``ROWS_PER_BUCKET`` rows is split into *order-preserving* buckets: all rows of bucket ``b`` come before
all rows of bucket ``b + 1``. The rows are exchanged by (keys, bucket), a window sees one bucket, and the bucket totals (a small
table) supply the offset at which each bucket starts. Which groups are large is counted first, in a job of its own; where none is,
plain windows over the groups do. Statistics of large groups are attached by a salted join (or a broadcast of that
small table), never by an exchange on the group keys alone, which the window above would reuse.

Buckets of values follow a quantile sketch of the group's distinct values, written once as a small table, so a recomputed task
sees the same edges and outliers or packed values do not fill one bucket. Buckets of digests are even by themselves.

Key columns must not be NULL: rows with a NULL key belong to no group and disappear, as they do in the
grouped reports this library reproduces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selroute.session import durable

# Rows one window task is meant to handle; groups beyond it are split.
ROWS_PER_BUCKET = 1 << 20
# Edges between value buckets come in two levels of this many, so finding a row's bucket takes two short scans.
EDGE_FAN = 64
# Finer buckets for taking the first rows of a shuffle: only one bucket per group is ever moved.
TAKE_BUCKET_ROWS = 1 << 12
# A small table is repeated this often to meet rows that are spread over as many salts.
SALTS = 64

_BUCKET = "__bucket"


def attach(
    df: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join a table with at most one row per ``keys`` without sending a key's rows to one task.

    The rows are spread over salts by a hash of ``spread``. Without keys, ``small`` has a single row and is broadcast.
    """
    if not keys:
        return df.crossJoin(F.broadcast(small))
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    return df.withColumn("__salt", salt).join(salted, [*keys, "__salt"], how).drop("__salt")


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))) if keys else df


def large_groups(df: DataFrame, keys: Sequence[str], rows_per_bucket: int) -> DataFrame | None:
    """(keys, __rows) of the groups that one window task should not take, or nothing if there is none."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    large = durable(sizes.where(F.col("__rows") > rows_per_bucket))
    return None if large.isEmpty() else large


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, Column],
    bucket: str | None = None,
) -> DataFrame:
    """Add ``<name>_upto`` (inclusive running sum in ``order``) and ``<name>_total`` per measure.

    ``bucket`` names a column that sorts before ``order``; without it the caller states that every
    group is small (for example one row per model).
    """
    keys = list(keys)
    if bucket is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        added = {}
        for name, measure in measures.items():
            added[f"{name}_upto"] = F.sum(measure).over(upto)
            added[f"{name}_total"] = F.sum(measure).over(whole)
        return df.withColumns(added)

    cell_keys = [*keys, bucket]
    within = Window.partitionBy(*cell_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"__upto_{n}": F.sum(c).over(within) for n, c in measures.items()})
    # The cell totals combine before their shuffle, so the rows themselves are moved once, for the windows.
    cells = df.groupBy(*cell_keys).agg(*[F.sum(c).alias(f"__cell_{n}") for n, c in measures.items()])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    starts = cells.select(
        *cell_keys,
        *[F.coalesce(F.sum(f"__cell_{n}").over(earlier), F.lit(0)).alias(f"__start_{n}") for n in measures],
        *[F.sum(f"__cell_{n}").over(group).alias(f"{n}_total") for n in measures],
    )
    joined = local.join(starts, cell_keys)
    return joined.withColumns({f"{n}_upto": F.col(f"__start_{n}") + F.col(f"__upto_{n}") for n in measures}).drop(
        *[f"__{part}_{n}" for part in ("upto", "start") for n in measures]
    )


def bucket_total(rows: Column, rows_per_bucket: int) -> Column:
    """How many buckets a group of ``rows`` rows gets; small groups stay whole."""
    return F.when(rows <= rows_per_bucket, F.lit(1)).otherwise(F.ceil(rows / F.lit(rows_per_bucket))).cast("long")


def with_value_bucket(
    df: DataFrame, keys: Sequence[str], value: str, descending: bool, large: DataFrame, rows_per_bucket: int
) -> DataFrame:
    """Number the rows of large groups (one row per distinct value) by the edges of a quantile sketch."""
    x = F.col(value).cast("double")
    probabilities = [i / EDGE_FAN**2 for i in range(1, EDGE_FAN**2)]
    theirs = attach(df, large, keys, [value])
    sketch = theirs.groupBy(*keys).agg(F.percentile_approx(x, probabilities, 10 * EDGE_FAN**2).alias("__edges"))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(EDGE_FAN - 1)), lambda k: F.get("__edges", k * EDGE_FAN - 1))
    edges = durable(sketch.withColumn("__coarse", coarse))

    def below(array: Column) -> Column:
        return F.size(F.filter(array, lambda edge: edge < x))

    first = below(F.col("__coarse"))
    place = first * EDGE_FAN + below(F.slice("__edges", first * EDGE_FAN + 1, F.lit(EDGE_FAN - 1)))
    placed = attach(df, edges, keys, [value], "left")
    bucket = F.when(F.col("__edges").isNull(), F.lit(0)).otherwise(-place if descending else place).cast("long")
    return placed.withColumn(_BUCKET, bucket).drop("__edges", "__coarse")


def heavy_values(df: DataFrame, keys: Sequence[str], value: str, large: DataFrame, rows_per_bucket: int) -> DataFrame | None:
    """(keys, value, __cuts) of the values that hold more rows of a large group than one task should take, or nothing.

    Only values with a good part of their group count (others fit into its buckets): such a value is an edge of the sketch for
    certain, so it is the largest value of its own bucket."""
    times = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__times"))
    often = attach(times.where(F.col("__times") > rows_per_bucket), large, keys, [value]).where(F.col("__times") * 1024 > F.col("__rows"))
    heavy = durable(often.select(*keys, value, F.ceil(F.col("__times") / rows_per_bucket).cast("long").alias("__cuts")))
    return None if heavy.isEmpty() else heavy


def row_running(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    digest: str,
    tie: Sequence[str],
    measures: Mapping[str, Column],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Running totals row by row, the greatest value first and equal values in digest order, without a join on the value.

    Buckets follow the values; a value that holds too many rows for one bucket is cut further by its digests, which are even."""
    df = _with_keys(df, keys)
    order = [F.col(value).desc(), F.col(digest), *[F.col(t) for t in tie]]
    large = large_groups(df, keys, rows_per_bucket)
    if large is None:
        return running_totals(df, keys, order, measures)
    placed = with_value_bucket(df, keys, value, True, large, rows_per_bucket)
    heavy = heavy_values(df, keys, value, large, rows_per_bucket)
    if heavy is not None:
        # The heavy value is the greatest of its bucket, so its cuts come before all else in there.
        prefix = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        cut = F.coalesce(F.shiftrightunsigned(prefix * F.col("__cuts"), 32), F.lit((1 << 31) - 1).cast("long"))
        placed = attach(placed, heavy, [*keys, value], [digest], "left").withColumn(_BUCKET, F.col(_BUCKET) * (1 << 31) + cut).drop("__cuts")
    return running_totals(placed, keys, order, measures, bucket=_BUCKET).drop(_BUCKET)


def value_running(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Mapping[str, Column],
    descending: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per distinct (keys, value): each measure summed, its running sum and its group total.

    The first step collapses equal values before anything is shuffled, so tied scores cost one row. These counts are written
    once; sizes of groups, edges of buckets, offsets and the result are all read from them, so ``df`` is read a single time.
    Groups are sized by their distinct values.
    """
    names = list(measures)
    counted = durable(_with_keys(df, keys).groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in measures.items()]))
    direction = F.col(value).desc() if descending else F.col(value).asc()
    totals = {n: F.col(n) for n in names}
    large = large_groups(counted, keys, rows_per_bucket)
    if large is None:
        return running_totals(counted, keys, [direction], totals)
    cut = with_value_bucket(counted, keys, value, descending, large, rows_per_bucket)
    return running_totals(cut, keys, [direction], totals, bucket=_BUCKET).drop(_BUCKET)


def seeded_digest(seed: Column | int | str, *ids: str) -> Column:
    """A reproducible shuffle key that any engine with md5 can recompute."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(i).cast("string") for i in ids]
    return F.md5(F.concat_ws("-", seed.cast("string"), *parts))


def digest_running(
    df: DataFrame,
    keys: Sequence[str],
    digest: str,
    tie: Sequence[str],
    measures: Mapping[str, Column],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Running totals in digest order; a digest is uniform, so its prefix cuts even buckets."""
    df = _with_keys(df, keys)
    order = [F.col(digest), *[F.col(t) for t in tie]]
    large = large_groups(df, keys, rows_per_bucket)
    if large is None:
        return running_totals(df, keys, order, measures)
    prefix = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    cut = bucket_total(F.coalesce("__rows", F.lit(1)), rows_per_bucket)
    placed = attach(df, large, keys, [digest], "left").withColumn(_BUCKET, F.shiftrightunsigned(prefix * cut, 32)).drop("__rows")
    return running_totals(placed, keys, order, measures, bucket=_BUCKET).drop(_BUCKET)


def seeded_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: Column | int | str,
    ids: Sequence[str],
    rank: str = "rank",
    size: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Position of each row in the seeded shuffle of its group, starting at 1."""
    base = df.withColumn("__digest", seeded_digest(seed, *ids))
    ranked = digest_running(base, list(keys), "__digest", list(ids), {"__n": F.lit(1)}, rows_per_bucket)
    ranked = ranked.withColumn(rank, F.col("__n_upto").cast("long"))
    if size:
        ranked = ranked.withColumn(size, F.col("__n_total").cast("long"))
    return ranked.drop("__digest", "__n_upto", "__n_total")


def seeded_take(
    df: DataFrame,
    keys: Sequence[str],
    seed: Column | int | str,
    ids: Sequence[str],
    k: str,
    size: str,
    rows_per_bucket: int = TAKE_BUCKET_ROWS,
) -> DataFrame:
    """The first ``k`` rows of each group's seeded shuffle; all rows of a group that has fewer.

    ``k`` and ``size`` (rows of the group) are columns that are constant per group; ``ids`` are unique in it.
    Counts per digest bucket tell in which bucket the k-th row lies. Only that bucket is shuffled and ranked to
    find the k-th digest; every row is then kept or dropped inside its own task by comparing with it.
    """
    spot = F.struct("__digest", *ids)
    prefix = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long")
    slot = F.shiftrightunsigned(prefix * bucket_total(F.col(size), rows_per_bucket), 32)
    placed = df.withColumn("__digest", seeded_digest(seed, *ids)).withColumn(_BUCKET, slot)
    cells = placed.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("__n"), F.max(k).alias("__k"))
    upto = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("__k") - (F.col("__upto") - F.col("__n"))
    edge = cells.withColumn("__upto", F.sum("__n").over(upto)).select(*keys, _BUCKET, "__n", room.alias("__room"))
    edge = edge.where((F.col("__room") > 0) & (F.col("__room") <= F.col("__n"))).drop("__n")
    within = Window.partitionBy(*keys, _BUCKET).orderBy("__digest", *ids)
    last = (
        placed.select(*dict.fromkeys([*keys, _BUCKET, "__digest", *ids]))
        .join(edge, [*keys, _BUCKET])
        .withColumn("__rank", F.row_number().over(within))
        .where(F.col("__rank") == F.col("__room"))
        .select(*keys, spot.alias("__last"))
    )
    kept = attach(placed, last, list(keys), list(ids), "left").where(F.col("__last").isNull() | (spot <= F.col("__last")))
    return kept.select(*df.columns)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every group in ``order``, by an aggregate that combines before the shuffle.

    ``order`` must end in a unique column so that the choice is fixed. Descending numeric columns are
    passed negated.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Linear-interpolation quantiles from running counts; no group is gathered into one task."""
    present = df.where(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double"))
    runs = value_running(present, keys, "__v", {"__c": F.lit(1)}, descending=False, rows_per_bucket=rows_per_bucket)
    last = F.col("__c_total") - 1
    start, stop = F.col("__c_upto") - F.col("__c"), F.col("__c_upto")

    def at(position: Column) -> Column:
        return F.max(F.when((start <= position) & (position < stop), F.col("__v")))

    picked = []
    for name, p in probs.items():
        picked.append(at(F.floor(last * F.lit(p))).alias(f"__lo_{name}"))
        picked.append(at(F.ceil(last * F.lit(p))).alias(f"__hi_{name}"))
    wide = runs.groupBy(*keys).agg(F.max("__c_total").alias("__n"), *picked)
    spot = F.col("__n") - 1
    return wide.select(
        *keys,
        *[
            (
                F.col(f"__lo_{n}")
                + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * (spot * F.lit(p) - F.floor(spot * F.lit(p)))
            ).alias(n)
            for n, p in probs.items()
        ],
    )
