"""Score arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def nan_to_null(value: Column) -> Column:
    """Missing numbers arrive as NaN in some dumps; comparisons need them as NULL."""
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def at_least(value: Column, threshold: Column) -> Column:
    """``value >= threshold`` with a missing value counting as false."""
    return F.coalesce(nan_to_null(value.cast("double")) >= threshold, F.lit(False))


def blend(first: Column, second: Column, alpha: Column) -> Column:
    return alpha * first + (F.lit(1.0) - alpha) * second


def arg_max_name(scores: Column, names: Sequence[str]) -> Column:
    """Name of the greatest entry of an array; the first one on ties."""
    spot = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), spot)


def to_binary(value: Column) -> Column:
    """Text is 1 only when it says true; numbers are 1 when non-zero; missing stays missing.

    Boolean text is matched first, so a string column may mix ``True``/``False`` with numbers.
    """
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    return (
        F.when(text == "true", 1)
        .when(text.isNull() | (text == "nan"), None)
        .when(number.isNotNull(), (number != 0).cast("int"))
        .otherwise(0)
        .cast("int")
    )


def histogram_slot(value: Column, lower: Column, upper: Column, bins: int) -> Column:
    """Index of the equal-width bin; the last bin is closed on the right."""
    width = (upper - lower) / F.lit(float(bins))
    return F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((value - lower) / width), F.lit(bins - 1))).cast("int")
