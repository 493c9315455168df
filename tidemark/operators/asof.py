"""What was known at a time: visibility filters, backward as-of joins and interval joins.

Interval joins are equi-joins on the buckets that an interval touches, so they shuffle by key instead of comparing
every pair; the exact condition follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scan


def visible(facts: DataFrame, at: Column | int, known_at: str = "known_at") -> DataFrame:
    """Facts that were available at a time."""
    return facts.filter(F.col(known_at) <= at)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, prefix: str, span: int | Column) -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    Both sides go to blocks of ``span`` of time, so that a key is as many tasks as it has blocks. A block begins with the
    last right row before it, which comes from one row for each block; within it, right rows come first at equal times and
    are carried forward. The right side's columns are prefixed; no row is lost or added. Ties on the right are settled
    by all its columns.
    """
    right, carried = right.filter(F.col(right_time).isNotNull()), F.struct(*[F.col(c) for c in right.columns])
    kind, row = right.select(carried.alias("x")).schema["x"].dataType, F.struct(*left.columns)
    a = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), row.alias("__row"), F.lit(None).cast(kind).alias("__right"), scan.block_of(left_time, span).alias(scan.BLOCK))
    none = F.lit(None).cast(a.schema["__row"].dataType).alias("__row")
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), none, carried.alias("__right"), scan.block_of(right_time, span).alias(scan.BLOCK))
    def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__t"), "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
        held = rows.withColumn("__right", F.last("__right", ignorenulls=True).over(order)).filter("__side = 1")
        return held.select("__row.*", *[F.col(f"__right.{c}").alias(f"{prefix}{c}") for c in right.columns if c not in by])

    if scan.few(a) and scan.few(b):
        return joined(a.unionByName(b), by)
    last = b.groupBy(*by, scan.BLOCK).agg(F.max(F.struct("__t", "__right"))["__right"].alias("x"))
    met = a.select(*by, scan.BLOCK).distinct().withColumn("x", F.lit(None).cast(kind)).unionByName(last)
    earlier = Window.partitionBy(*by).orderBy(scan.BLOCK).rangeBetween(Window.unboundedPreceding, -1)  # one or two rows for each block
    begin = met.withColumn("__right", F.last("x", ignorenulls=True).over(earlier)).filter("__right is not null")
    c = begin.groupBy(*by, scan.BLOCK).agg(F.first("__right").alias("__right"))
    c = c.select(*by, F.lit(None).cast(a.schema["__t"].dataType).alias("__t"), F.lit(-1).alias("__side"), none, "__right", scan.BLOCK)
    return joined(a.unionByName(b).unionByName(c), [*by, scan.BLOCK])


def interval_join(
    points: DataFrame, spans: DataFrame, by: list[str], at: str, low: str, high: str, bucket: int, how: str = "inner"
) -> DataFrame:
    """Points with the spans [low, high] of the same key that hold them.

    ``bucket`` is a width like that of the spans: a span goes to each bucket it touches, a point to its own.
    """
    p = points.withColumn("__b", F.floor(F.col(at) / bucket))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    same = [p[k].eqNullSafe(s[k]) for k in by] + [p["__b"] == s["__b"], p[at] >= s[low], p[at] <= s[high]]
    met = p.join(s, same, how)
    if how in ("left_semi", "left_anti"):
        return met.drop("__b")
    return met.select(*[p[c] for c in points.columns], *[s[c] for c in spans.columns if c not in by])


def overlapping(spans: DataFrame, windows: DataFrame, low: str, high: str, w_low: str, w_high: str, bucket: int) -> DataFrame:
    """Spans (low, high) that overlap any window (w_low, w_high), each once; a span without an end is still open."""
    last = windows.agg(F.max(w_high)).first()[0]
    if last is None:
        return spans.limit(0)
    end = F.greatest(F.col(low), F.least(F.coalesce(high, F.lit(last)), F.lit(last)))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(end / bucket))))
    w = windows.select(w_low, w_high).withColumn("__b", F.explode(F.sequence(F.floor(F.col(w_low) / bucket), F.floor(F.col(w_high) / bucket))))
    hit = s.join(w, (s["__b"] == w["__b"]) & (s[high].isNull() | (s[high] > w[w_low])) & (s[low] < w[w_high]), "left_semi")
    return hit.drop("__b").distinct()


def last_known(df: DataFrame, by: list[str], order: str, value: str, out: str, span: int | Column) -> DataFrame:
    """Carry the last known value forward, over blocks of ``span`` of the order."""
    return scan.running(df, by, [order], scan.block_of(order, span), {out: scan.last(F.col(value))})


def snapshot(facts: DataFrame, at: int, by: list[str], known_at: str = "known_at") -> DataFrame:
    """The last visible fact of each key."""
    rest = [c for c in facts.columns if c not in by]
    found = visible(facts, at, known_at).groupBy(*by).agg(F.max(F.struct(known_at, *[c for c in rest if c != known_at])).alias("f"))
    return found.select(*by, *[F.col(f"f.{c}").alias(c) for c in rest])
