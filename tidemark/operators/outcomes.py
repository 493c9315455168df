"""What followed: forward windows on a dense grid, censoring, first contacts and their classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import COMPLETE

#: Bars of a block of time at least.
BLOCK_BARS = 4096
RIGHT_CENSORED, GAP, MISSING_A, ZERO_A = "RIGHT_CENSORED", "GAP", "MISSING_A", "ZERO_A"


def origins(lo: int, hi: int, step: int) -> Column:
    """A regular grid of origins in [lo, hi)."""
    return F.explode(F.sequence(F.lit(lo), F.lit(hi - step), F.lit(step)))


def forward(observed: DataFrame, horizon: int) -> DataFrame:
    """For each bar what the next ``horizon`` bars of its series did, in units of ``a``.

    The grid is dense, so the future is a frame of rows, not a join. Nothing is stated of an incomplete future: it is
    flagged RIGHT_CENSORED where the grid ends, GAP where a bar is missing. A series is cut into blocks of time, and a
    block has the first ``horizon`` bars of what follows it as well, so a long series is many tasks.
    """
    width = F.col("t1") - F.col("t0")
    span = max(BLOCK_BARS, 4 * horizon) * width
    place = lambda t: F.floor(t / span)
    blocks = F.sequence(place(F.col("t0") - horizon * width), place(F.col("t0")))
    by_time = Window.partitionBy("series", "__block").orderBy("t0")
    future = by_time.rowsBetween(1, horizon)
    out = (
        observed.withColumn("__block", F.explode(blocks))
        .withColumns(
            {
                "horizon_end": F.col("t1") + horizon * width,
                "valid": F.count_if(F.col("status") == COMPLETE).over(future),
                "in_range": F.count(F.lit(1)).over(future),
                "max_high": F.max("h").over(future),
                "min_low": F.min("l").over(future),
                "close_after": F.lead("c", horizon).over(by_time),
            }
        )
        .filter(F.col("__block") == place(F.col("t0")))
        .drop("__block")
    )
    censored = F.col("in_range") < horizon  # the grid has ended
    gap = F.col("valid") < F.col("in_range")
    flags = F.filter(
        F.array(F.when(censored, RIGHT_CENSORED), F.when(gap, GAP)), lambda x: x.isNotNull()
    )
    complete = ~censored & ~gap
    usable = complete & (F.col("status") == COMPLETE) & (F.col("a") > 0)
    out = out.withColumns({name: F.when(complete, F.col(name)) for name in ("max_high", "min_low", "close_after")})
    a_status = (
        F.when(F.col("a").isNull(), F.coalesce("a_r", F.lit("A_UNAVAILABLE"))).when(F.col("a") <= 0, "A_NOT_POSITIVE").otherwise("VALID")
    )
    c, a, zero = F.col("c"), F.col("a"), F.lit(0.0)
    return out.withColumns(
        {
            "flags": flags,
            "a_status": a_status,
            "future_complete": complete,
            "final": F.when(usable, (F.col("close_after") - c) / a),
            "up": F.when(usable, F.greatest(zero, F.col("max_high") - c) / a),
            "down": F.when(usable, F.greatest(zero, c - F.col("min_low")) / a),
        }
    )


def daily_relation(observed: DataFrame, daily: DataFrame) -> DataFrame:
    """Structure of the last day that had ended, and how it relates to the bar's own."""
    days = daily.select("series", F.col("t1").alias("day_end"), F.col("structure").alias("s_day"))
    day = F.col("t1") - F.pmod("t1", F.lit(86_400_000))
    out = observed.withColumn("day_end", day).join(days, ["series", "day_end"], "left")
    own = F.coalesce("structure", F.lit("UNAVAILABLE"))
    of_day = F.coalesce("s_day", F.lit("UNAVAILABLE"))
    relation = (
        F.when(~own.isin("UP", "DOWN"), "NOT_APPLICABLE")
        .when(of_day == own, "CONCORDANT")
        .when(of_day.isin("UP", "DOWN"), "OPPOSITE")
        .otherwise(of_day)
    )
    return out.withColumn("relation", relation).withColumn("s_bar", own).withColumn("s_day", of_day)


def first_touch(starts: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """First contacts with ``f`` (favourable) and ``g`` (adverse) markers in the next ``horizon`` bars.

    ``starts`` has series, t1, d (+1 or -1), c, a, f and g. The future comes by an equi-join on computed bar starts.
    Only the run up to the first gap counts; the class is null unless the whole future is there. Contacts in one bar
    are ordered only if its open is at or beyond a marker.
    """
    step = F.col("t1") - F.col("t0")
    future = starts.select(
        "series", "t1", "d", "c", "a", "f", "g", F.posexplode(F.sequence(F.col("t1"), F.col("t1") + (horizon - 1) * step, step)).alias("i", "t0")
    )
    met = future.join(bars.select("series", "t0", "status", "o", "h", "l", F.col("c").alias("close")), ["series", "t0"], "left")
    gap = F.when(F.coalesce(F.col("status") != COMPLETE, F.lit(True)), F.col("i"))
    met = met.withColumn("first_gap", F.min(gap).over(Window.partitionBy("series", "t1")))
    known = F.col("first_gap").isNull() | (F.col("i") < F.col("first_gap"))
    long = F.col("d") == 1
    hit_f = F.when(long, F.col("h") >= F.col("f")).otherwise(F.col("l") <= F.col("f"))
    hit_g = F.when(long, F.col("l") <= F.col("g")).otherwise(F.col("h") >= F.col("g"))
    open_f = F.when(long, F.col("o") >= F.col("f")).otherwise(F.col("o") <= F.col("f"))
    open_g = F.when(long, F.col("o") <= F.col("g")).otherwise(F.col("o") >= F.col("g"))
    when = lambda hit, x: F.when(known & hit, x)
    i = F.col("i")
    found = met.groupBy("series", "t1", "d", "c", "a", "f", "g").agg(
        F.min("first_gap").alias("first_gap"),
        F.count_if(known).alias("bars"),
        F.min(when(hit_f, i)).alias("f_bar"),
        F.min_by(open_f, when(hit_f, i)).alias("f_open"),
        F.min(when(hit_g, i)).alias("g_bar"),
        F.min_by(open_g, when(hit_g, i)).alias("g_open"),
        F.max(F.when(known, F.col("h"))).alias("max_high"),
        F.min(F.when(known, F.struct((-F.col("h")).alias("k"), i.alias("i")))).getField("i").alias("max_high_bar"),
        F.min(F.when(known, F.col("l"))).alias("min_low"),
        F.min(F.when(known, F.struct(F.col("l").alias("k"), i.alias("i")))).getField("i").alias("min_low_bar"),
        F.max_by("close", F.when(known, i)).alias("close_last"),
    )
    return found.withColumn("class", F.when(F.col("first_gap").isNull() & F.col("f").isNotNull(), contact_class()))


def contact_class() -> Column:
    f, g = F.col("f_bar"), F.col("g_bar")
    return (
        F.when(f.isNull() & g.isNull(), "NEITHER")
        .when(g.isNull(), "F_ONLY")
        .when(f.isNull(), "A_ONLY")
        .when(f < g, "F_BEFORE_A")
        .when(g < f, "A_BEFORE_F")
        .when(F.col("f_open"), "F_BEFORE_A")
        .when(F.col("g_open"), "A_BEFORE_F")
        .otherwise("BOTH_UNORDERED")
    )


def normalised(touched: DataFrame) -> DataFrame:
    """Final, favourable and adverse way in units of ``a``, of the known part of the future."""
    a, c, zero, long = F.col("a"), F.col("c"), F.lit(0.0), F.col("d") == 1
    up, down = F.greatest(zero, F.col("max_high") - c) / a, F.greatest(zero, c - F.col("min_low")) / a
    usable = (F.col("bars") > 0) & (a > 0)
    return (
        touched.withColumn("final", F.when(usable, F.col("d") * (F.col("close_last") - c) / a))
        .withColumn("favourable", F.when(usable, F.when(long, up).otherwise(down)))
        .withColumn("adverse", F.when(usable, F.when(long, down).otherwise(up)))
        .withColumn("partial", F.col("first_gap").isNotNull())
    )
