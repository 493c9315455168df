"""Running values over long series, by blocks of the order instead of one window for each key.

Every block of rows gets a carry: what the blocks before it come to (a sum, a greatest or least value, the last known
one). Carries come from one small row for each block; running values are then worked out inside blocks and joined with the
carry. Sum, extreme and last are associative, so the result does not depend on where blocks end, and a key with most
rows is as many tasks as it has blocks. Only blocks of a key, never its rows, are ordered together.

Rows that Spark knows to be few (``few``: by the size it estimates for the plan, as it does before it broadcasts) are one
block, and need no carry. The result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about, where they are evenly spaced.
BLOCK_ROWS = 4096

#: Estimated bytes up to which rows are one block.
SMALL_BYTES = 64 << 20

BLOCK = "__block"


def few(rows: DataFrame) -> bool:
    """Whether Spark's own estimate of the size is small; estimates of joins are products, so what it can't tell is not few."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


@dataclass(frozen=True)
class Running:
    """``kind`` of value over the rows up to this one, or with ``before`` up to the one before. Nulls are passed over."""

    kind: str
    value: Column
    before: bool = False


_SUM, _MAX, _MIN, _LAST = "sum", "max", "min", "last"


def total(value: Column, before: bool = False) -> Running:
    return Running(_SUM, value, before)


def greatest(value: Column, before: bool = False) -> Running:
    return Running(_MAX, value, before)


def least(value: Column, before: bool = False) -> Running:
    return Running(_MIN, value, before)


def last(value: Column, before: bool = False) -> Running:
    return Running(_LAST, value, before)


def _of_block(run: Running, order: list[str]) -> Column:
    if run.kind == _LAST:
        return F.max_by(run.value, F.when(run.value.isNotNull(), F.struct(*order)))
    return {_SUM: F.sum, _MAX: F.max, _MIN: F.min}[run.kind](run.value)


def _over(kind: str, value: Column | str, window) -> Column:
    if kind == _LAST:
        return F.last(value, ignorenulls=True).over(window)
    return {_SUM: F.sum, _MAX: F.max, _MIN: F.min}[kind](value).over(window)


def _joined(kind: str, carry: Column, own: Column) -> Column:
    if kind == _SUM:
        return F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(carry + own)
    if kind == _LAST:
        return F.coalesce(own, carry)
    return (F.greatest if kind == _MAX else F.least)(carry, own)


def carries(rows: DataFrame, keys: list[str], order: list[str], block: Column, runs: dict[str, Running]) -> DataFrame:
    """(keys, block, one column for each run): what the blocks before this one come to, for each block with rows."""
    blocks = rows.withColumn(BLOCK, block).groupBy(*keys, BLOCK).agg(*[_of_block(r, order).alias(n) for n, r in runs.items()])
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*keys, BLOCK, *[_over(r.kind, n, earlier).alias(n) for n, r in runs.items()])


def running(rows: DataFrame, keys: list[str], order: list[str], block: Column, runs: dict[str, Running]) -> DataFrame:
    """``rows`` with a column for each of ``runs``, over each key's rows in ``order``.

    ``block`` is a column that does not fall as the order rises. ``rows`` is read twice: write what is dear to make first.
    Rows of one key with the same order are taken in any order.
    """
    if few(rows):
        whole = Window.partitionBy(*keys).orderBy(*order)
        frames = {r: whole.rowsBetween(Window.unboundedPreceding, -1 if r else 0) for r in (False, True)}
        return rows.withColumns({n: _over(r.kind, r.value, frames[r.before]) for n, r in runs.items()})
    before = {n: f"__before_{n}" for n in runs}
    known = carries(rows, keys, order, block, {before[n]: r for n, r in runs.items()})
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    frame = {r: inside.rowsBetween(Window.unboundedPreceding, -1 if r else 0) for r in (False, True)}
    own = rows.withColumn(BLOCK, block)
    own = own.withColumns({f"__own_{n}": _over(r.kind, r.value, frame[r.before]) for n, r in runs.items()})
    same = [own[k].eqNullSafe(known[k]) for k in (*keys, BLOCK)]
    met = own.join(known, same, "left").select(*[own[c] for c in own.columns], *[known[c] for c in before.values()])
    made = {n: _joined(r.kind, F.col(before[n]), F.col(f"__own_{n}")) for n, r in runs.items()}
    return met.withColumns(made).select(*[c for c in rows.columns if c not in runs], *runs)


def block_of(order: Column | str, span: Column | int) -> Column:
    """Number of the block of the given span that a time, or any whole number, lies in."""
    at = F.col(order) if isinstance(order, str) else order
    return F.floor(at / (F.lit(span) if isinstance(span, int) else span)).cast("long")
