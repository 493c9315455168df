"""Decisions on movement legs: recognition, reaction, resumption, plan, and one slot for each series.

Each leg is followed on its own over the bars of its life, all legs at once; which legs a single slot could take is
settled afterwards, as a chain of successors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import COMPLETE
from tidemark.operators.search import chain
from tidemark.sources.shared import materialize


@dataclass(frozen=True)
class Rules:
    """Limits of a decision; lengths in bars, distances in units of ``a`` or of the leg."""

    min_bars: int = 1
    max_bars: int = 32
    amplitude: float = 3.0
    depth_min: float = 0.25
    depth_max: float = 0.75
    counter_closes: int = 1
    expiry: int = 12
    stop_buffer: float = 0.10
    reward_risk: float = 1.5
    holding: int = 16
    slippage: float = 0.0003
    fee: float = 0.0005
    stress_slippage: float = 0.001
    stress_fee: float = 0.001
    notional: float = 1000.0


def by_sign(d: Column, long: Column, short: Column) -> Column:
    return F.when(d == 1, long).otherwise(short)


def legs(sequence: DataFrame, observed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Legs with the reasons against them, in fixed order; none means RECOGNIZED."""
    bar = observed.select("series", "t0", F.col("pos").alias("leg_pos"), "a", "structure")
    found = sequence.filter("action <> 'KEEP' and p0 is not null").join(bar, ["series", "t0"])
    d = F.when(F.col("p1.kind") == "HIGH", 1).otherwise(-1)
    width = F.col("t1") - F.col("t0")
    found = found.withColumn("d", d).withColumn("leg_bars", ((F.col("p1.c0") - F.col("p0.c0")) / width).cast("long"))
    found = found.withColumn("length", F.col("d") * (F.col("p1.price") - F.col("p0.price")))
    structure = ~F.coalesce(F.col("structure") == by_sign(F.col("d"), F.lit("UP"), F.lit("DOWN")), F.lit(False))
    volatile = ~F.coalesce(F.col("a") > 0, F.lit(False))
    reasons = F.array(
        F.when(structure, "ABSTAIN_STRUCTURE"),
        F.when(~F.col("leg_bars").between(rules.min_bars, rules.max_bars), "ABSTAIN_DURATION"),
        F.when(volatile, "ABSTAIN_VOLATILITY_UNAVAILABLE"),
        F.when(~volatile & ~(F.col("length") >= rules.amplitude * F.col("a")), "ABSTAIN_AMPLITUDE"),
    )
    return found.select(
        "series",
        "segment",
        F.concat_ws(":", F.when(F.col("d") == 1, "LONG").otherwise("SHORT"), F.col("p0.c0"), F.col("p1.c0"), F.col("t1")).alias("leg_id"),
        F.col("t1").alias("leg_t1"),
        width.alias("width"),
        "d",
        "length",
        "leg_bars",
        F.col("a").alias("a0"),
        F.col("p0.price").alias("p0"),
        F.col("p1.price").alias("p1"),
        F.col("p1.c0").alias("p1_t0"),
        F.filter(reasons, lambda x: x.isNotNull()).alias("reasons"),
    )


def follow(legs: DataFrame, observed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Each recognized leg's bars from the second anchor on, with the state that each close would give.

    The bars come by an equi-join on computed starts. States in order of precedence; a leg ends at its first state
    that is not WAIT.
    """
    life = F.sequence(F.col("p1_t0"), F.col("p1_t0") + (rules.expiry + 1) * F.col("width"), F.col("width"))
    bars = observed.select("series", "t0", "t1", "status", F.col("segment").alias("bar_segment"), "o", "h", "l", "c", "structure")
    rows = legs.filter(F.size("reasons") == 0).select("*", F.posexplode(life).alias("since", "t0")).join(bars, ["series", "t0"])
    by_leg = Window.partitionBy("series", "leg_id").orderBy("t0")
    after = by_leg.rowsBetween(Window.unboundedPreceding, 0)
    d, later = F.col("d"), F.col("since") > 0
    against = F.when(later & (d * (F.col("c") - F.lag("c").over(by_leg)) < 0), 1).otherwise(0)
    low, high = F.min(F.when(later, F.col("l"))).over(after), F.max(F.when(later, F.col("h"))).over(after)
    rows = (
        rows.withColumn("extreme", by_sign(d, low, high))
        .withColumn("reached", by_sign(d, high >= F.col("p1"), low <= F.col("p1")))
        .withColumn("against", against)
        .withColumn("counter", F.sum("against").over(after))
        .withColumn("depth", d * (F.col("p1") - F.col("extreme")) / F.col("length"))
        .withColumn("h_prev", F.lag("h").over(by_leg))
        .withColumn("l_prev", F.lag("l").over(by_leg))
        .filter(F.col("t1") >= F.col("leg_t1"))
    )
    broken = (F.col("status") != COMPLETE) | ~F.col("bar_segment").eqNullSafe(F.col("segment"))
    opposite = F.coalesce(F.col("structure") == by_sign(d, F.lit("DOWN"), F.lit("UP")), F.lit(False))
    waits = (F.col("depth") < rules.depth_min) | (F.col("counter") < rules.counter_closes)
    resumes = by_sign(
        d,
        (F.col("c") > F.col("h_prev")) & (F.col("c") > F.col("o")),
        (F.col("c") < F.col("l_prev")) & (F.col("c") < F.col("o")),
    )
    state = (
        F.when(broken, "INVALIDATED_DATA")
        .when(opposite, "INVALIDATED_STRUCTURE")
        .when((F.col("depth") > rules.depth_max) | (d * (F.col("c") - F.col("p0")) <= 0), "INVALIDATED_DEPTH")
        .when(F.col("reached"), "INVALIDATED_TARGET_REACHED")
        .when(F.col("since") > rules.expiry, "EXPIRED")
        .when(waits | ~((F.col("t1") > F.col("leg_t1")) & resumes), "WAIT")
        .otherwise("CALL")
    )
    return rows.withColumn("state", state)


def decisions(legs: DataFrame, observed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each leg: its outcome, when it came, and the plan of a call."""
    ended = (
        follow(legs, observed, rules)
        .filter("state <> 'WAIT'")
        .groupBy("series", "leg_id")
        .agg(F.min_by(F.struct("state", "t1", "extreme", "depth", "counter", "c"), "t1").alias("e"))
    )
    rows = legs.join(ended, ["series", "leg_id"], "left")
    d = F.col("d")
    stop = F.col("e.extreme") - d * rules.stop_buffer * F.col("a0")
    price = F.col("e.c") * (1 + d * rules.slippage)
    rows = rows.withColumn("stop", stop).withColumn("risk", d * (price - F.col("stop"))).withColumn("gain", d * (F.col("p1") - price))
    sound = (F.col("stop") > 0) & (F.col("risk") > 0) & (F.col("gain") > 0) & (F.col("gain") / F.col("risk") >= rules.reward_risk)
    called = F.col("e.state") == "CALL"
    outcome = (
        F.when(F.size("reasons") > 0, F.get("reasons", 0))
        .when(F.col("e").isNull(), "OPEN_AT_END")
        .when(called & ~F.coalesce(sound, F.lit(False)), "ABSTAIN_REWARD_RISK")
        .otherwise(F.col("e.state"))
    )
    rows = rows.withColumn("outcome", outcome)
    is_call = F.col("outcome") == "CALL"
    return rows.select(
        "series",
        "leg_id",
        "leg_t1",
        "width",
        "d",
        "length",
        "leg_bars",
        "a0",
        "p1",
        "outcome",
        (F.size("reasons") == 0).alias("recognized"),
        F.col("e.t1").alias("ended_at"),
        F.col("e.depth").alias("depth"),
        F.col("e.counter").alias("counter"),
        *[F.when(is_call, F.col(c)).alias(c) for c in ("stop", "risk", "gain")],
        F.when(is_call, (F.col("p1") + rules.reward_risk * F.col("stop")) / (1 + rules.reward_risk)).alias("entry_bound"),
    )


def one_slot(rows: DataFrame, start: str, end: str, holds: Column) -> DataFrame:
    """Which rows a single slot of each series takes: a row that holds it keeps it until its end, inclusive.

    Rows without an end hold it for good. A row that finds the slot taken is ``SKIPPED_BUSY``. Who comes after a row that
    has the slot is the first one to start after its end, whoever had it before; the takers are that chain.
    """
    order = Window.partitionBy("series").orderBy(start, "leg_id")
    until = F.when(holds, F.coalesce(end, F.lit(1 << 62)))
    ranked = materialize(rows.select("series", "leg_id", F.col(start).alias("at"), F.row_number().over(order).cast("long").alias("idx"), until.alias("until")))
    # How many rows have started by the end of each: starts and ends in one order, starts first.
    starts = ranked.select("series", F.col("at").alias("when"), F.lit(0).alias("is_end"), F.lit(None).cast("long").alias("of"))
    ends = ranked.filter("until is not null").select("series", F.col("until").alias("when"), F.lit(1).alias("is_end"), F.col("idx").alias("of"))
    upto = F.sum(1 - F.col("is_end")).over(Window.partitionBy("series").orderBy("when", "is_end"))
    begun = starts.unionByName(ends).withColumn("begun", upto).filter("is_end = 1").select("series", F.col("of").alias("idx"), "begun")
    last = ranked.groupBy("series").agg(F.max("idx").alias("last"))
    links = ranked.join(begun, ["series", "idx"], "left").join(last, "series")
    then = F.greatest(F.col("idx"), F.coalesce("begun", F.lit(0))) + 1
    links = links.select("series", "idx", F.when(then <= F.col("last"), then).alias("next"))
    taken = ranked.join(chain(links, ["series"]), ["series", "idx"]).select("series", "leg_id", F.lit(True).alias("free"))
    return rows.join(taken, ["series", "leg_id"], "left").withColumn("slot", F.when(F.col("free"), "TAKEN").otherwise("SKIPPED_BUSY")).drop("free")
