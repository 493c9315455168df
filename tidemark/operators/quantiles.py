"""Exact quantiles of large groups by selection: histograms are refined until each order statistic is one value.

A quantile lies between two order statistics. Each of them has an interval that holds it and the number of values
below; a pass counts the values of every interval in bins, and the bin that holds the statistic becomes its interval,
narrowed to the least and greatest value there. Bins are even in the value and in its logarithm by turns, so far-apart
values take no more passes than close ones. Counts are added up before they are shuffled, so no task holds a
group's values, however large or uneven the group is. A pass reads what is left in the intervals, a small part after the
first one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.measures import describe
from tidemark.operators import scan
from tidemark.sources.shared import materialize

#: Bins of an interval.
BINS = 4096


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """``ranks`` (by, k, lo, hi) with x, the k-th least value (from 0) of each group; lo and hi bound it.

    ``rows`` has no null or NaN values; every k is less than the group's rows.
    """
    at = materialize(ranks.select(*by, "k", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.lit(0).cast("long").alias("below")))
    x = F.col(value).cast("double")
    rows = rows.select(*by, x.alias("__x"))
    y = lambda v: F.when(v > 0, F.log2(v) + 1100).when(v < 0, -F.log2(-v) - 1100).otherwise(0.0)  # noqa: E731  rises with v
    turn = 0
    while not at.filter("lo < hi").isEmpty():
        spans = at.filter("lo < hi").select(*by, "lo", "hi").distinct()  # disjoint within a group, or one
        met = rows.join(spans, _same(rows, spans, by) & (rows["__x"] >= spans["lo"]) & (rows["__x"] <= spans["hi"]))
        low, high, here = (F.col(c) if turn % 2 == 0 else y(F.col(c)) for c in ("lo", "hi", "__x"))
        part = F.least(F.coalesce(F.floor(F.try_divide(here - low, high - low) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
        turn += 1
        kept = met.select(*[rows[k] for k in by], "lo", "hi", part.alias("bin"), "__x")
        bins = kept.groupBy(*by, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("least"), F.max("__x").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*by, "lo", "hi").orderBy("bin"))  # at most BINS rows
        bins = bins.withColumn("upto", upto).withColumnsRenamed({k: f"__{k}" for k in (*by, "lo", "hi")})
        own = [at[k].eqNullSafe(bins[f"__{k}"]) for k in (*by, "lo", "hi")]
        inside = (F.col("k") >= F.col("below") + F.col("upto") - F.col("n")) & (F.col("k") < F.col("below") + F.col("upto"))
        found = at.join(bins, reduce(lambda a, b: a & b, [*own, inside]))
        narrowed = found.select(*by, "k", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"))
        at = materialize(narrowed.unionByName(at.filter("lo >= hi")))
    return at.select(*by, "k", F.col("lo").alias("x"))


def described(df: DataFrame, by: list[str], value: Column, quantiles: tuple[float, ...]) -> DataFrame:
    """``measures.describe`` of each group: n, mean, min, max and the quantiles, with linear interpolation.

    Few rows are described by Spark's own aggregate, which keeps a group's values in one buffer; more by selection.
    """
    rows = df.select(*by, value.alias("__x"))
    stats = describe(F.col("__x"), quantiles)
    names = [f"p{round(q * 100)}" for q in quantiles]
    if scan.few(rows):
        return rows.groupBy(*by).agg(*stats)
    rows = materialize(rows)
    base = materialize(rows.groupBy(*by).agg(*describe(F.col("__x"), ())))
    place = [(name, F.lit(q) * (F.col("n") - 1)) for name, q in zip(names, quantiles, strict=True)]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for _, p in place])))
    ranks = base.filter("n > 0").select(*by, F.explode(wanted).alias("k"), F.col("min").alias("lo"), F.col("max").alias("hi"))
    found = order_statistics(rows.filter("__x is not null"), by, "__x", ranks)
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("__at"))
    met = base.join(values, _same(base, values, by), "left").select(*[base[c] for c in base.columns], "__at")

    def between(p: Column) -> Column:
        low, high = F.try_element_at("__at", F.floor(p)), F.try_element_at("__at", F.ceil(p))
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return met.select(*by, *[c for c in base.columns if c not in by], *[between(p).alias(name) for name, p in place])
