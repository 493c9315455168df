"""Movements, groups and repeated attempts, as windows and equi-joins.

A movement version is an APPEND or REPLACE of the alternating sequence whose two anchors differ in its direction. It
is active until the next version of its side, a gap, or the end. A group shares the first anchor. An attempt is a
close beyond the bar before it, after a close against the movement; the next attempt of the group needs another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, scan
from tidemark.operators.bars import COMPLETE, with_previous
from tidemark.operators.observe import LEVELS
from tidemark.sources.shared import materialize

NEW_VERSION, SEGMENT_RESET, END_OF_STUDY = "NEW_VERSION_SAME_DIRECTION", "SEGMENT_RESET", "END_OF_STUDY"


def versions(sequence: DataFrame, observed: DataFrame) -> DataFrame:
    """Movement versions with the time [active_from, retired_at) and why they ended."""
    found = sequence.filter("action <> 'KEEP' and p0 is not null").select(
        "series", "segment", "t1", "action", "version", "p0", "p1", F.when(F.col("p1.kind") == "HIGH", 1).otherwise(-1).alias("d")
    )
    length = F.col("d") * (F.col("p1.price") - F.col("p0.price"))
    found = found.withColumn("length", length).filter("length > 0")
    ends = observed.filter(F.col("status") == COMPLETE).groupBy("series", "segment").agg(
        F.max("t1").alias("segment_last"), F.max(F.col("t1") - F.col("t0")).alias("width")
    )
    study = observed.groupBy("series").agg(F.max("t1").alias("study_end"))
    side = Window.partitionBy("series", "d").orderBy("t1")
    found = (
        found.join(ends, ["series", "segment"])
        .join(study, "series")
        .withColumn("next_t1", F.lead("t1").over(side))
        .withColumn("reset_at", F.when(F.col("segment_last") < F.col("study_end"), F.col("segment_last") + F.col("width")))
    )
    retired = F.least("next_t1", "reset_at", "study_end")
    # A gap ends a movement before a new version of the same time could.
    reason = (
        F.when(retired == F.col("reset_at"), SEGMENT_RESET).when(retired == F.col("next_t1"), NEW_VERSION).otherwise(END_OF_STUDY)
    )
    key = F.concat_ws(":", F.when(F.col("d") == 1, "LONG").otherwise("SHORT"), F.col("p0.c0"))
    return found.select(
        "series",
        "segment",
        "d",
        key.alias("group_id"),
        F.concat_ws(":", key, F.col("p1.c0"), F.col("t1")).alias("version_id"),
        F.col("t1").alias("active_from"),
        retired.alias("retired_at"),
        reason.alias("retire_reason"),
        "action",
        "version",
        "length",
        F.col("p0.price").alias("p0_price"),
        F.col("p0.c0").alias("p0_t0"),
        F.col("p1.price").alias("p1_price"),
        F.col("p1.c0").alias("p1_t0"),
    )


def _counted(observed: DataFrame, block_bars: int) -> DataFrame:
    """Complete bars with running counts of closes below and above the close before, and the bar before."""
    rows = with_previous(observed, {"__c": "c", "h_prev": "h", "l_prev": "l"}, block_bars)
    step = lambda x: F.coalesce(x.cast("long"), F.lit(0))
    counts = {"falls": scan.total(step(F.col("c") < F.col("__c"))), "rises": scan.total(step(F.col("c") > F.col("__c")))}
    return scan.running(rows, ["series"], ["t0"], scan.block_of("t0", block_bars * (F.col("t1") - F.col("t0"))), counts).filter(F.col("status") == COMPLETE)


def attempts(versions: DataFrame, observed: DataFrame, block_bars: int = scan.BLOCK_ROWS) -> DataFrame:
    """Attempts with their place in the group.

    An attempt needs a close against the movement after the candle of the second anchor and after the last attempt of
    the group. With N the running count of such closes, that is: N is above its value at the anchor, and this is the
    first trigger of the group with this N. At any time at most one version of a side is active, so a bar that triggers a
    side looks its version up: the last one that began, if it has not ended. No bar meets more than that.
    """
    bars = _counted(observed.select("series", "segment", "status", "t0", "t1", "pos", "o", "h", "l", "c"), block_bars)
    width = F.col("t1") - F.col("t0")
    sides = F.explode(F.array(F.struct(F.lit(1).alias("d"), F.col("falls").alias("n")), F.struct(F.lit(-1).alias("d"), F.col("rises").alias("n")))).alias("s")
    both = bars.select("series", "segment", "t0", "t1", "pos", "o", "c", "h_prev", "l_prev", sides).select("*", "s.d", "s.n").drop("s")
    anchor = both.select("series", "d", F.col("t0").alias("p1_t0"), F.col("pos").alias("p1_pos"), F.col("n").alias("n0"), width.alias("width"))
    known = versions.join(anchor, ["series", "d", "p1_t0"]).select(
        "series", "d", F.col("segment").alias("in"), "group_id", "version_id", "active_from", "retired_at", "length", "p1_price", "p0_price", "p1_t0", "p1_pos", "n0", "width"
    )
    known = materialize(known)  # read for carries and for rows
    up = (F.col("c") > F.col("h_prev")) & (F.col("c") > F.col("o"))
    down = (F.col("c") < F.col("l_prev")) & (F.col("c") < F.col("o"))
    triggers = both.filter(F.when(F.col("d") == 1, up).otherwise(down)).withColumn("width", width)
    met = asof.asof_join(triggers, known, ["series", "d"], "t1", "active_from", "v_", block_bars * F.col("width"))
    met = met.withColumnsRenamed({f"v_{c}": c for c in known.columns if c not in ("series", "d", "width")})
    found = met.filter(
        (F.col("t1") < F.col("retired_at")) & (F.col("segment") == F.col("in")) & (F.col("pos") > F.col("p1_pos") + 1) & (F.col("n") > F.col("n0"))
    )
    again = Window.partitionBy("series", "group_id", "segment", "n").orderBy("t1")
    group = Window.partitionBy("series", "group_id").orderBy("t1")
    return (
        found.withColumn("__first", F.row_number().over(again))
        .filter("__first = 1")
        .withColumn("ordinal", F.row_number().over(group))
        .select(
            "series", "group_id", "version_id", "ordinal", "d", "t0", "t1", "c", "length", "p1_price", "p0_price", "p1_t0",
            (F.col("pos") - F.col("p1_pos")).alias("bars_since_p1"),
            (F.col("n") - F.col("n0")).alias("counter_closes"),
        )
    )


def reactions(attempts: DataFrame, observed: DataFrame) -> DataFrame:
    """How far price went back since the second anchor: extreme, depth and whether the anchor was touched again."""
    bars = observed.filter(F.col("status") == COMPLETE).select("series", F.col("t0").alias("b0"), "h", "l")
    step = attempts.withColumn("b0", F.explode(F.sequence(F.col("p1_t0"), F.col("t0"), (F.col("t1") - F.col("t0")))))
    met = step.filter("b0 > p1_t0").join(bars, ["series", "b0"])
    long = F.col("d") == 1
    found = met.groupBy("series", "group_id", "ordinal", "d", "t1", "length", "p1_price").agg(
        F.min("l").alias("low"), F.max("h").alias("high")
    )
    extreme = F.when(long, F.col("low")).otherwise(F.col("high"))
    touched = F.when(long, F.col("high") >= F.col("p1_price")).otherwise(F.col("low") <= F.col("p1_price"))
    return found.select(
        "series",
        "group_id",
        "ordinal",
        "t1",
        extreme.alias("extreme"),
        (F.col("d") * (F.col("p1_price") - extreme) / F.col("length")).alias("depth"),
        touched.alias("p1_touched"),
    )


def joint_profile(d: Column) -> Column:
    """CONCORDANT, OPPOSITE or DISCORDANT of structure, order and slope of the averages; UNAVAILABLE if one is missing."""
    want, other = F.when(d == 1, "UP").otherwise("DOWN"), F.when(d == 1, "DOWN").otherwise("UP")
    order, slope, s = d * F.col("dist"), d * F.col("slope"), F.col("structure")
    return (
        F.when(s.isNull() | order.isNull() | slope.isNull(), "UNAVAILABLE")
        .when((s == want) & (order > 0) & (slope > 0), "CONCORDANT")
        .when((s == other) & (order < 0) & (slope < 0), "OPPOSITE")
        .otherwise("DISCORDANT")
    )


def known_versions(versions: DataFrame, at: int) -> DataFrame:
    """Versions known at a time; an end that came later is not known, nor its reason."""
    ended = F.col("retired_at") <= at
    seen = versions.filter(F.col("active_from") <= at)
    return seen.withColumn("retire_reason", F.when(ended, F.col("retire_reason"))).withColumn("retired_at", F.when(ended, F.col("retired_at")))


def snapshots(attempts: DataFrame, reactions: DataFrame, state: DataFrame) -> DataFrame:
    """The state of the bar of each attempt as seen in its direction; ``state`` has levels and the day's structure.

    Distances are in units of ``a`` and null where it is missing or zero.
    """
    back = reactions.select("series", "group_id", "ordinal", "extreme", "depth", "p1_touched")
    own = attempts.drop("t0", "c")
    met = own.join(back, ["series", "group_id", "ordinal"]).join(state.drop("t0"), ["series", "t1"])
    d = F.col("d")
    met = nearest_levels(met, d)
    over = lambda x: F.when(F.col("a") != 0, x / F.col("a"))
    side = lambda up: F.when(d == 1, "UP").otherwise("DOWN") == up
    crossed = F.when(F.col("cross") == "NONE", "NONE").when(side(F.col("cross")), "IN_DIRECTION").when(F.col("cross").isNotNull(), "AGAINST")
    anchored = F.when(F.col("anchors_r").isNull(), F.when((F.col("p0.kind") == "LOW") == (d == 1), "CONCORDANT").otherwise("OPPOSITE"))
    return met.select(
        "*",
        joint_profile(d).alias("profile"),
        crossed.alias("cross_side"),
        anchored.alias("anchors_side"),
        *[(d * F.col(c)).alias(f"d_{c}") for c in ("dist", "slope", "place")],
        over(F.col("length")).alias("length_over_a"),
        over(d * (F.col("p1_price") - F.col("c"))).alias("to_p1"),
        over(d * (F.col("extreme") - F.col("c"))).alias("to_extreme"),
        F.col("ahead.kind").alias("ahead_kind"),
        over(F.col("ahead.gap")).alias("ahead_gap"),
        F.col("behind.kind").alias("behind_kind"),
        over(F.col("behind.gap")).alias("behind_gap"),
    )


def nearest_levels(leveled: DataFrame, d: Column) -> DataFrame:
    """The nearest level ahead and behind in a direction; ties by kind; a level at the close is neither."""
    rows = F.array(*[F.struct((d * (F.col(p) - F.col("c"))).alias("raw"), F.lit(k).alias("kind"), F.col(p).alias("price")) for k, p in LEVELS])

    def best(sign: int) -> Column:
        found = F.filter(rows, lambda x: x["raw"].isNotNull() & (sign * x["raw"] > 0))
        return F.array_min(F.transform(found, lambda x: F.struct(F.abs(x["raw"]).alias("gap"), x["kind"].alias("kind"), x["price"].alias("price"))))

    return leveled.withColumn("ahead", best(1)).withColumn("behind", best(-1))


def overlap(spans: DataFrame, by: list[str], low: str, high: str, span: int) -> DataFrame:
    """Peak number of spans [low, high) at once, and how many meet a neighbour; ends come before starts at a tie.

    Open spans, the latest end before a span and the earliest start after it run over blocks of ``span`` of time.
    """
    same = materialize(spans.groupBy(*by, low, high).agg(F.count(F.lit(1)).alias("__n")))
    ends = F.array(F.struct(F.col(low).alias("t"), F.col("__n").alias("step")), F.struct(F.col(high).alias("t"), (-F.col("__n")).alias("step")))
    moves = same.select(*by, F.explode(ends).alias("m")).select(*by, "m.t", "m.step")
    counted = scan.running(moves, by, ["t", "step"], scan.block_of("t", span), {"open": scan.total(F.col("step"))})
    peak = counted.groupBy(*by).agg(F.max("open").alias("peak"))
    rows = scan.running(same, by, [low, high], scan.block_of(low, span), {"__until": scan.greatest(F.col(high), before=True)})
    rows = rows.withColumns({"__low": -F.col(low), "__high": -F.col(high)})  # the order reversed
    rows = scan.running(rows, by, ["__low", "__high"], scan.block_of("__low", span), {"__next": scan.greatest(F.col("__low"), before=True)})
    meets = (F.col(low) < F.col("__until")) | (F.col(high) > -F.col("__next")) | ((F.col("__n") > 1) & (F.col(low) < F.col(high)))
    met = rows.groupBy(*by).agg(F.sum("__n").alias("spans"), F.sum(F.when(meets, F.col("__n")).otherwise(0)).alias("overlapping"))
    return met.join(peak, by)
