"""Measures: a value, or the reason why there is none; and aggregates that keep what is unknown unknown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

INSUFFICIENT_HISTORY = "INSUFFICIENT_HISTORY"
INCOMPLETE_INPUT = "INCOMPLETE_INPUT"
ZERO_DENOMINATOR = "ZERO_DENOMINATOR"
NO_CONFIRMED_PIVOTS = "NO_CONFIRMED_PIVOTS"
ANCHORS_EQUAL = "ANCHORS_EQUAL"


def val(value: Column) -> Column:
    """A known value."""
    return F.struct(value.alias("v"), F.lit(None).cast("string").alias("r"))


def miss(reason: str | Column, kind: str = "double") -> Column:
    """No value, with its reason."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(None).cast(kind).alias("v"), reason.alias("r"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator`` over a measure: its reason if it has none, ZERO_DENOMINATOR where it is a known zero."""
    return (
        F.when(denominator["v"].isNull(), miss(denominator["r"]))
        .when(denominator["v"] == 0, miss(ZERO_DENOMINATOR))
        .otherwise(val(numerator / denominator["v"]))
    )


def signed(measure: Column, sign: Column) -> Column:
    """A measure times +1 or -1, its reason kept."""
    return F.when(measure["v"].isNull(), measure).otherwise(val(sign * measure["v"]))


def strict_sum(value: Column) -> Column:
    """Sum that is null as soon as one value is, the opposite of SQL's."""
    return F.when(F.count_if(value.isNull()) == 0, F.coalesce(F.sum(value), F.lit(0.0)))


def describe(value: Column, quantiles: Iterable[float], prefix: str = "") -> list[Column]:
    """n, mean, min, max and linearly interpolated quantiles of the known values."""
    out = [
        F.count(value).alias(f"{prefix}n"),
        F.avg(value).alias(f"{prefix}mean"),
        F.min(value).alias(f"{prefix}min"),
        F.max(value).alias(f"{prefix}max"),
    ]
    quantiles = list(quantiles)
    found = F.percentile(value, F.array(*[F.lit(q) for q in quantiles]))  # one aggregate for all of them
    return out + [F.get(found, i).alias(f"{prefix}p{round(q * 100)}") for i, q in enumerate(quantiles)]


def share(part: Column, whole: Column) -> Column:
    """A share that is null where there is nothing to share."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
