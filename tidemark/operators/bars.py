"""Complete, gap-aware time bars from ticks or minutes.

A bar is COMPLETE or it has no prices. A grid makes gaps rows, and a run of complete bars is a segment: whatever
looks back starts again with each one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY, floor_day, interval_start
from tidemark.operators import scan
from tidemark.sources.shared import materialize

COMPLETE, INCOMPLETE = "COMPLETE", "INCOMPLETE"
PRICES = ("o", "h", "l", "c")


def aggregate(ticks: DataFrame, width: int, min_ticks: int = 1) -> DataFrame:
    """Tumbling bars of ticks (series, t, at, price, qty) on a grid from the first to the last day of each series.

    ``t`` is in milliseconds, ``at`` orders ticks. A bar with fewer than ``min_ticks`` ticks is INCOMPLETE.
    """
    places = grid(ticks, width).select("series", "t0", *[F.lit(None).cast(ticks.schema[c].dataType).alias(c) for c in ("at", "price", "qty")], F.lit(0).alias("n"))
    dealt = ticks.select("series", interval_start(F.col("t"), width).alias("t0"), "at", "price", "qty", F.lit(1).alias("n"))
    found = dealt.unionByName(places).groupBy("series", "t0").agg(  # one shuffle for ticks and grid
        F.min_by("price", "at").alias("o"),
        F.max("price").alias("h"),
        F.min("price").alias("l"),
        F.max_by("price", "at").alias("c"),
        F.sum("qty").alias("v"),
        F.sum("n").alias("ticks"),
    )
    return priced(found, width, F.col("ticks") >= max(min_ticks, 1))


def grid(ticks: DataFrame, width: int) -> DataFrame:
    """(series, t0) for every bar from the first to the last day of each series."""
    span = ticks.groupBy("series").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    last = floor_day(F.col("hi")) + DAY - width
    return span.select("series", F.explode(F.sequence(floor_day(F.col("lo")), last, F.lit(width))).alias("t0"))


def priced(bars: DataFrame, width: int, complete: Column) -> DataFrame:
    """Bars with their status; prices only where complete."""
    bars = bars.withColumn("ok", F.coalesce(complete, F.lit(False)))
    return bars.select(
        "series",
        "t0",
        (F.col("t0") + width).alias("t1"),
        F.when(F.col("ok"), COMPLETE).otherwise(INCOMPLETE).alias("status"),
        "ticks",
        *[F.when(F.col("ok"), F.col(c)).alias(c) for c in (*PRICES, "v")],
    )


def regroup(bars: DataFrame, width: int) -> DataFrame:
    """Wider bars from narrower ones: COMPLETE only if every one inside is."""
    start = interval_start(F.col("t0"), width).alias("t0")
    whole = F.count_if(F.col("status") != COMPLETE) == 0
    out = bars.groupBy("series", start).agg(
        whole.alias("ok"),
        F.sum("ticks").alias("ticks"),
        F.min_by("o", "t0").alias("o"),
        F.max("h").alias("h"),
        F.min("l").alias("l"),
        F.max_by("c", "t0").alias("c"),
        F.sum("v").alias("v"),
    )
    return out.select(
        "series",
        "t0",
        (F.col("t0") + width).alias("t1"),
        F.when(F.col("ok"), COMPLETE).otherwise(INCOMPLETE).alias("status"),
        "ticks",
        *[F.when(F.col("ok"), F.col(c)).alias(c) for c in (*PRICES, "v")],
    )


def coverage(minutes: DataFrame, *by: str) -> DataFrame:
    """Expected, valid, missing and invalid minutes."""
    return minutes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(F.col("status") == "VALID").alias("valid"),
        F.count_if(F.col("status") == "MISSING").alias("missing"),
        F.count_if(F.col("status") == "INVALID").alias("invalid"),
    )


def with_previous(bars: DataFrame, columns: dict[str, str], block_bars: int = scan.BLOCK_ROWS) -> DataFrame:
    """``bars`` with columns (new name: name) of the bar that ends where this one begins; null where there is none.

    Bars go to blocks of time, and a bar that ends a block goes to the next one as well, so a long series is many tasks.
    """
    if scan.few(bars):
        whole = Window.partitionBy("series").orderBy("t0")
        next_to = F.lag("t1").over(whole) == F.col("t0")
        return bars.withColumns({new: F.when(next_to, F.lag(name).over(whole)) for new, name in columns.items()})
    place = lambda t: scan.block_of(t, block_bars * (F.col("t1") - F.col("t0")))
    rows = bars.withColumn(scan.BLOCK, F.explode(F.array_distinct(F.array(place("t0"), place("t1")))))
    by_time = Window.partitionBy("series", scan.BLOCK).orderBy("t0")
    follows = F.lag("t1").over(by_time) == F.col("t0")
    found = rows.withColumns({new: F.when(follows, F.lag(name).over(by_time)) for new, name in columns.items()})
    return found.filter(F.col(scan.BLOCK) == place("t0")).drop(scan.BLOCK)


def segments(bars: DataFrame, block_bars: int = scan.BLOCK_ROWS) -> DataFrame:
    """``segment``: number of the run of complete bars; ``pos``: place in it from 1. Null for incomplete bars.

    ``bars`` are written once, unless they are few. Segments so far, and the start of the last one, are running values
    over blocks of time.
    """
    width, complete = F.col("t1") - F.col("t0"), F.col("status") == COMPLETE
    rows = with_previous(bars if scan.few(bars) else materialize(bars), {"__was": "status"}, block_bars)
    opened = complete & ~F.coalesce(F.col("__was") == COMPLETE, F.lit(False))
    runs = {"segment": scan.total(opened.cast("long")), "__start": scan.last(F.when(opened, F.col("t0")))}
    found = scan.running(rows, ["series"], ["t0"], scan.block_of("t0", block_bars * width), runs)
    pos = ((F.col("t0") - F.col("__start")) / width + 1).cast("int")
    return found.select(*bars.columns, F.when(complete, F.col("segment")).alias("segment"), F.when(complete, pos).alias("pos"))


def daily_partial(bars: DataFrame) -> DataFrame:
    """Daily candles of the complete bars so far, flagged where a day has less than all of them."""
    day = floor_day(F.col("t0")).alias("t0")
    return bars.groupBy("series", day).agg(
        F.min_by("o", F.when(F.col("o").isNotNull(), F.col("t0"))).alias("o"),
        F.max("h").alias("h"),
        F.min("l").alias("l"),
        F.max_by("c", F.when(F.col("c").isNotNull(), F.col("t0"))).alias("c"),
        (F.count_if(F.col("status") != COMPLETE) > 0).alias("partial"),
    )
