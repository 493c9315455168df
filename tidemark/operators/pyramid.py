"""A stored pyramid of extremes over long series, and first contacts found in it by climbing and descending.

``FAN`` rows of a series make a block with its highest and lowest price and whether a row is missing; ``FAN`` blocks make a
block of the next level, until one is left. A search from a row on looks at the rest of its block, at the rest of the
block's block, and so on up to where the first contact must lie, then down to the row: two equi-joins for each level,
however far it goes, and no row for each step. Levels are written once and serve every search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import materialize

FAN = 64
#: Kinds of contact: a high at or above the level, a low at or below it, a missing row.
HIGH, LOW, MISSING = "HIGH", "LOW", "MISSING"


@dataclass
class Pyramid:
    """``levels[k]``: keys, block, items (at, hi, lo, bad) of the block's children at level k; ``origin`` and ``width`` of its grid."""

    keys: list[str]
    levels: list[DataFrame]
    origin: int
    width: int

    def place(self, time: Column) -> Column:
        """Position of the row that holds an instant."""
        return F.floor((time - F.lit(self.origin)) / self.width).cast("long")

    def time(self, place: Column) -> Column:
        return F.lit(self.origin) + place * self.width


def build(rows: DataFrame, keys: list[str], width: int, high: Column, low: Column, missing: Column, fan: int = FAN) -> Pyramid:
    """The pyramid of ``rows`` (keys, t0) on a grid of the given width; a row that is not there is never found."""
    span = rows.agg(F.min("t0").alias("lo"), F.max("t0").alias("hi")).first()
    made = Pyramid(keys, [], span.lo or 0, width)
    at = made.place(F.col("t0"))
    below = rows.select(*keys, at.alias("at"), high.cast("double").alias("hi"), low.cast("double").alias("lo"), F.coalesce(missing, F.lit(True)).alias("bad"))
    last = ((span.hi or 0) - made.origin) // width
    while True:
        level = below.groupBy(*keys, F.floor(F.col("at") / fan).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "hi", "lo", "bad"))).alias("items"))
        made.levels.append(materialize(level))
        last //= fan
        if last == 0:
            return made
        best = lambda f, c: f(F.transform("items", lambda x: x[c])).alias(c)
        below = made.levels[-1].select(*keys, F.col("block").alias("at"), best(F.array_max, "hi"), best(F.array_min, "lo"), F.exists("items", lambda x: x["bad"]).alias("bad"))


def first_contact(pyramid: Pyramid, asks: DataFrame, fan: int = FAN) -> DataFrame:
    """``asks`` (keys, kind, start, until, level and others) with ``hit``: the first position from ``start`` to ``until`` with that contact."""
    keys = pyramid.keys

    def reaches(x: Column) -> Column:
        touch = F.when(F.col("kind") == HIGH, x["hi"] >= F.col("level")).when(F.col("kind") == LOW, x["lo"] <= F.col("level"))
        return F.coalesce(F.when(F.col("kind") == MISSING, x["bad"]).otherwise(touch), F.lit(False))

    def look(rows: DataFrame, k: int, block: Column, after: Column, out: str) -> DataFrame:
        """``out``: the first child after ``after`` in the block of level ``k`` that is reached."""
        table = pyramid.levels[k].select(*keys, F.col("block").alias("__block"), F.col("items").alias("__items"))
        met = rows.withColumn("__block", block).join(table, [*keys, "__block"], "left")
        found = F.get(F.filter("__items", lambda x: (x["at"] > after) & reaches(x)), F.lit(0))["at"]
        return met.withColumn(out, found).drop("__block", "__items")

    top = len(pyramid.levels)
    rows, known = asks, F.lit(False)
    for k in range(top):  # up: a level is looked at only where those below it have nothing
        here = F.floor((F.col("start") - 1) / fan**k).cast("long")
        block = F.when(~known & (F.col("until") >= F.col("start")), F.floor(F.greatest(here, F.lit(0)) / fan))
        rows = look(rows, k, block, here, f"__up{k}")
        known = known | F.col(f"__up{k}").isNotNull()
    rows = rows.withColumn("__down", F.lit(None).cast("long"))
    for k in range(top - 1, 0, -1):  # down: into the child that was found
        rows = rows.withColumn("__child", F.coalesce(f"__up{k}", "__down"))
        rows = look(rows, k - 1, F.col("__child"), F.lit(-1), "__down").drop("__child")
    hit = F.coalesce("__up0", "__down")
    return rows.withColumn("hit", F.when(hit <= F.col("until"), hit)).select(*asks.columns, "hit")
