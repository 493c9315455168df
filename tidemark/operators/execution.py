"""Two grains: decisions on bars, executed on minutes.

A call is entered at the open of the minute that its bar ends with. From there the first of these ends the trade: a missing
minute, a touch of the stop that is in force, a touch of the target, an exit that is due. Where each of them comes first
is asked of a pyramid of minutes, one question for each stop in force, so a trade has as many rows as stops, not as
minutes. At the minute that comes first the order is fixed: missing, open beyond the stop, open beyond the target, exit
due, the new stop's activation, and within the minute the stop before the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import MINUTE
from tidemark.operators import pyramid, scan
from tidemark.operators.asof import interval_join
from tidemark.operators.bars import COMPLETE
from tidemark.operators.decisions import Rules, by_sign
from tidemark.operators.ledger import economics
from tidemark.sources.shared import materialize

TRADE = ["series", "leg_id"]


def quiet_minutes(found: DataFrame, bars: DataFrame, width: int, step: int = MINUTE) -> DataFrame:
    """Minutes of every bar: those of ``found`` where there are any, else flat at the close before; missing in incomplete bars.

    ``found`` has series, t0, o, h, l and c of the minutes with ticks.
    """
    grid = bars.select("series", (F.col("status") == COMPLETE).alias("ok"), F.explode(F.sequence(F.col("t0"), F.col("t1") - step, F.lit(step))).alias("t0"))
    met = materialize(grid.join(found.select("series", "t0", "o", "h", "l", "c"), ["series", "t0"], "left"))
    rows = scan.running(met, ["series"], ["t0"], scan.block_of("t0", scan.BLOCK_ROWS * step), {"__last": scan.last(F.col("c"), before=True)})
    price = lambda c: F.when(F.col("ok"), F.coalesce(c, "__last")).alias(c)
    known = F.col("ok") & F.coalesce("c", "__last").isNotNull()
    return rows.select("series", "t0", (F.col("t0") + step).alias("t1"), F.when(known, COMPLETE).otherwise("INCOMPLETE").alias("status"), *[price(c) for c in ("o", "h", "l", "c")])


def minute_pyramid(minutes: DataFrame, step: int = MINUTE) -> pyramid.Pyramid:
    return pyramid.build(minutes, ["series"], step, F.col("h"), F.col("l"), F.col("status") != COMPLETE)


def stop_history(filled: DataFrame, observed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Stops of each trade as rows (valid_from, valid_to, stop, origin): the first, and each that a confirmed pivot improves.

    A pivot of a bar is in force from the bar's end. Only bars with pivots meet trades, by buckets of time.
    """
    held = rules.holding * F.col("width")
    legs = filled.select(*TRADE, "d", "stop", "p1", "a0", "ended_at", "width", (F.col("ended_at") + held).alias("over"))
    found = observed.filter("pivot_kind is not null").select("series", F.col("t0").alias("bar"), "t1", "c", "structure", "pivot_kind", "pivot_price", "candidate_t0")
    bucket = rules.holding * 6 * 3_600_000
    met = interval_join(found, legs, ["series"], "bar", "ended_at", "over", bucket)
    d = F.col("d")
    proposal = F.col("pivot_price") - d * rules.stop_buffer * F.col("a0")
    opposite = F.coalesce(F.col("structure") == by_sign(d, F.lit("DOWN"), F.lit("UP")), F.lit(False))
    allowed = (
        (F.col("pivot_kind") == by_sign(d, F.lit("LOW"), F.lit("HIGH"))) & (F.col("candidate_t0") >= F.col("ended_at")) & ~opposite
        & (d * (F.col("c") - proposal) > 0) & (d * (F.col("p1") - proposal) > 0) & (proposal > 0) & (F.col("t1") < F.col("over"))
    )
    begin = legs.select(*TRADE, "d", F.col("ended_at").alias("valid_from"), F.col("stop").alias("proposed"), F.lit("INITIAL").alias("origin"))
    more = met.filter(allowed).select(*TRADE, "d", F.col("t1").alias("valid_from"), proposal.alias("proposed"), F.lit("TRAILED").alias("origin"))
    trade = Window.partitionBy(*TRADE).orderBy("valid_from")  # a trade's stops are at most its bars
    before = trade.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.col("d") * F.col("proposed")).over(before)
    rows = begin.unionByName(more).withColumn("__better", best.isNull() | (F.col("d") * F.col("proposed") > best)).filter("__better")
    return rows.select(*TRADE, "d", "valid_from", F.lead("valid_from").over(trade).alias("valid_to"), F.col("proposed").alias("stop"), "origin")


def structure_exits(filled: DataFrame, observed: DataFrame, width: int) -> DataFrame:
    """(series, leg_id, exit_due): the end of the first bar from the entry on whose structure is against the trade."""
    flag = lambda s: F.coalesce(F.col("structure") == s, F.lit(False)).cast("int")
    tower = pyramid.build(observed, ["series"], width, flag("DOWN"), -flag("UP"), F.lit(False))
    long, start = F.col("d") == 1, tower.place(F.col("ended_at"))
    asks = filled.select(*TRADE, F.when(long, pyramid.HIGH).otherwise(pyramid.LOW).alias("kind"), by_sign(F.col("d"), F.lit(1.0), F.lit(-1.0)).alias("level"), start.alias("start"), F.lit(1 << 60).alias("until"))
    return pyramid.first_contact(tower, asks).select(*TRADE, (tower.time(F.col("hit")) + width).alias("exit_due"))


def execute(trades: DataFrame, stops: DataFrame, minutes: DataFrame, tower: pyramid.Pyramid, step: int = MINUTE) -> DataFrame:
    """``trades`` (series, leg_id, d, entry_at, target, time_exit, exit_due, last_t0) with minute, reason, reference, intrabar, both, at_activation and final_stop.

    ``stops`` as of ``stop_history``. Without a reason the trade is open at the end of the minutes.
    """
    d = F.col("d")
    side = lambda up: by_sign(d, F.lit(pyramid.HIGH if up else pyramid.LOW), F.lit(pyramid.LOW if up else pyramid.HIGH))
    due = F.least("exit_due", "time_exit", F.when(F.col("last_t0") > F.col("entry_at"), F.col("last_t0")))
    trades = trades.withColumn("due", due)
    ask = lambda rows, kind, level, start, until, what: rows.select(
        *TRADE, F.lit(what).alias("what"), kind.alias("kind"), level.cast("double").alias("level"), tower.place(start).alias("start"), tower.place(until).alias("until")
    )
    entry, end = F.col("entry_at"), F.col("due")
    segments = stops.join(trades.select(*TRADE, "due"), TRADE)
    asks = (
        ask(trades, F.lit(pyramid.MISSING), F.lit(None), entry + step, end, "gap")
        .unionByName(ask(trades, side(True), F.col("target"), entry, end, "target"))
        .unionByName(ask(segments, side(False), F.col("stop"), F.col("valid_from"), F.least(F.col("valid_to") - step, end), "stop"))
    )
    hits = pyramid.first_contact(tower, asks).groupBy(*TRADE).agg(F.min("hit").alias("hit"))
    history = stops.groupBy(*TRADE).agg(F.sort_array(F.collect_list(F.struct("valid_from", "stop"))).alias("__stops"))
    met = trades.join(hits, TRADE, "left").join(history, TRADE).withColumn("minute", F.least(tower.time(F.col("hit")), end))
    in_force = lambda known: F.try_element_at(F.filter("__stops", known), F.lit(-1))["stop"]
    met = met.withColumn("stop_now", in_force(lambda x: x["valid_from"] <= F.col("minute")))
    met = met.withColumn("stop_before", F.coalesce(in_force(lambda x: x["valid_from"] < F.col("minute")), "stop_now"))
    price = minutes.select("series", F.col("t0").alias("minute"), "status", "o", "h", "l")
    met = met.join(price, ["series", "minute"], "left")
    o, target, later = F.col("o"), F.col("target"), F.col("minute") > entry
    beyond = lambda stop: d * (o - F.col(stop)) <= 0
    stop_hit = d * (by_sign(d, F.col("l"), F.col("h")) - F.col("stop_now")) <= 0
    target_hit = d * (by_sign(d, F.col("h"), F.col("l")) - target) >= 0

    def event(reason: str, reference: Column, stop: str, intrabar: bool = False, both: Column | None = None, activation: bool = False) -> Column:
        return F.struct(
            F.lit(reason).alias("reason"), reference.alias("reference"), F.lit(intrabar).alias("intrabar"), (F.lit(False) if both is None else both).alias("both"),
            F.lit(activation).alias("at_activation"), F.col(stop).alias("final_stop"),
        )

    found = (
        F.when(later & F.coalesce(F.col("status") != COMPLETE, F.lit(True)), event("UNRESOLVED_DATA_GAP", F.lit(None).cast("double"), "stop_before"))
        .when(later & beyond("stop_before"), event("STOP", o, "stop_before"))
        .when(later & (d * (o - target) >= 0), event("TARGET", o, "stop_before"))
        .when(later & (F.col("minute") >= F.col("exit_due")), event("EXIT_STRUCTURE", o, "stop_before"))
        .when(later & (F.col("minute") >= F.col("time_exit")), event("TIME_EXIT", o, "stop_before"))
        .when(later & (F.col("minute") >= F.col("last_t0")), event("END_OF_SEGMENT", o, "stop_before"))
        .when(later & beyond("stop_now"), event("STOP", o, "stop_now", activation=True))
        .when(stop_hit, event("STOP", F.col("stop_now"), "stop_now", True, target_hit))
        .when(target_hit, event("TARGET", target, "stop_now", True))
    )
    drop = ("hit", "__stops", "stop_now", "stop_before", "status", "o", "h", "l", "__event", "due")
    return met.withColumn("__event", found).select("*", "__event.*").drop(*drop)


def minute_trades(entered: DataFrame, observed: DataFrame, minutes: DataFrame, width: int, rules: Rules = Rules(), step: int = MINUTE) -> tuple[DataFrame, DataFrame]:
    """Filled calls executed on minutes with their economics, and the history of their stops.

    ``entered`` comes from ``ledger.entries`` over the minutes.
    """
    filled = entered.filter("entry_outcome = 'FILLED'")
    stops = materialize(stop_history(filled, observed, rules))
    due = structure_exits(filled, observed, width)
    rows = filled.join(due, TRADE, "left").select(
        *TRADE, "d", "qty", "entry", F.col("reference").alias("entry_reference"), "risk0", F.col("p1").alias("target"), F.col("stop").alias("stop0"), F.col("ended_at").alias("entry_at"),
        (F.col("ended_at") + rules.holding * F.col("width")).alias("time_exit"), "exit_due", "last_t0",
    )
    done = execute(materialize(rows), stops, minutes, minute_pyramid(minutes, step), step)
    exit_at = F.when(F.col("intrabar"), F.col("minute") + step).otherwise(F.col("minute"))
    named = done.withColumnsRenamed({"reference": "exit_reference", "entry_reference": "reference"}).withColumn("exit_at", F.when(F.col("reason").isNotNull(), exit_at))
    return economics(named, rules), stops
