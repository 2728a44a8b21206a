"""Wide and long forms, struct flattening and model-name clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Lift every nested struct field to the top level; arrays stay as they are."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    return df.select(
        *[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, ())]
    )


def normalise_model_name(name: Column) -> Column:
    """Lower case, double underscore and slash to one underscore."""
    return F.replace(F.replace(F.lower(name), F.lit("__"), F.lit("_")), F.lit("/"), F.lit("_"))


def name_collisions(df: DataFrame, model: str = "model") -> DataFrame:
    """Normalised names that more than one raw name maps to."""
    return (
        df.select(model)
        .distinct()
        .groupBy(normalise_model_name(F.col(model)).alias("name"))
        .agg(F.count(F.lit(1)).alias("n_raw"))
        .where("n_raw > 1")
    )


def model_columns(df: DataFrame, id_columns: Sequence[str]) -> list[str]:
    """Everything that is not an id column is a model; sorted by name."""
    return sorted(c for c in df.columns if c not in set(id_columns))


def to_long(df: DataFrame, id_columns: Sequence[str], name: str = "model", value: str = "correct") -> DataFrame:
    """Wide matrix to one row per (ids, model); missing cells stay as NULL rows."""
    return df.unpivot(list(id_columns), model_columns(df, id_columns), name, value)


def to_wide(
    df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence[str]
) -> DataFrame:
    """Long to wide with one value per cell; a second value in a cell is an error.

    ``values`` is the list of new columns, so that no extra job looks for them. The check rides on the
    same aggregate.
    """
    cell = F.when(F.count(value) > 1, F.raise_error(F.lit("more than one value in a cell"))).otherwise(F.first(value, True))
    return df.groupBy(*index).pivot(column, list(values)).agg(cell)


def pivot_mean(df: DataFrame, index: str, column: str, value: str, values: Sequence) -> DataFrame:
    """Mean per cell with the index in descending order."""
    return df.groupBy(index).pivot(column, list(values)).agg(F.avg(value)).orderBy(F.desc(index))


def merge_model_tables(df: DataFrame, index: Sequence[str], models: Sequence[str], value: str = "correct") -> DataFrame:
    """What N-1 full outer joins of per-model tables give, as one grouped pivot."""
    return to_wide(df, index, "model", value, models)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column a frame lacks becomes NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def name_values(df: DataFrame, column: str) -> list[str]:
    """The distinct names of a catalogue-sized column (models, thresholds), for use as pivot columns."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
