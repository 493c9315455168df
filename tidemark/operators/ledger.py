"""Modelled execution of calls on bars: entry, protection, exit, costs and the value path.

A call is entered at the open of the next bar. From there each bar is tested in a fixed order: a gap in the data, an
open beyond stop or target, an exit that is due, a stop that becomes active, and within the bar the stop before the
target. The first of these ends the trade. The protective stop only improves, so the stop at a bar is a running
extreme of the proposals before it and needs no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.measures import strict_sum
from tidemark.functions.scalars import MINUTE
from tidemark.operators.asof import interval_join
from tidemark.operators.bars import COMPLETE
from tidemark.operators.decisions import Rules, by_sign, one_slot


def entries(calls: DataFrame, observed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Calls with the outcome of their entry: FILLED, REJECTED_PRICE or CANCELLED."""
    quotes = observed.select("series", F.col("t0").alias("ended_at"), "status", F.col("o").alias("reference"))
    last = observed.groupBy("series").agg(F.max("t0").alias("last_t0"))
    met = calls.filter("outcome = 'CALL'").join(quotes, ["series", "ended_at"], "left").join(last, "series")
    d, price = F.col("d"), F.col("reference") * (1 + F.col("d") * rules.slippage)
    met = met.withColumn("entry", price)
    risk, gain = d * (F.col("entry") - F.col("stop")), d * (F.col("p1") - F.col("entry"))
    good = (risk > 0) & (gain > 0) & (gain / risk >= rules.reward_risk)
    outcome = (
        F.when(F.col("ended_at") >= F.col("last_t0"), "CANCELLED_END_OF_WINDOW")
        .when(F.coalesce(F.col("status") != COMPLETE, F.lit(True)), "CANCELLED_NO_QUOTE")
        .when(good, "FILLED")
        .otherwise("REJECTED_PRICE")
    )
    return met.withColumn("entry_outcome", outcome).withColumn("risk0", risk).withColumn("qty", rules.notional / F.col("entry"))


def path(filled: DataFrame, observed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The bars of each filled call with the stop of each bar and the event that it would give."""
    life = F.sequence(F.col("ended_at"), F.col("ended_at") + rules.holding * F.col("width"), F.col("width"))
    bars = observed.select(
        "series", "t0", "t1", "status", "o", "h", "l", "c", "structure", "pivot_kind", "pivot_price", "candidate_t0"
    )
    rows = filled.select("*", F.posexplode(life).alias("held", "t0")).drop("status").join(bars, ["series", "t0"])
    d = F.col("d")
    by_trade = Window.partitionBy("series", "leg_id").orderBy("t0")
    opposite = F.coalesce(F.col("structure") == by_sign(d, F.lit("DOWN"), F.lit("UP")), F.lit(False))
    proposal = F.col("pivot_price") - d * rules.stop_buffer * F.col("a0")
    allowed = (
        (F.col("pivot_kind") == by_sign(d, F.lit("LOW"), F.lit("HIGH")))
        & (F.col("candidate_t0") >= F.col("ended_at"))
        & (d * (F.col("c") - proposal) > 0)
        & (d * (F.col("p1") - proposal) > 0)
        & (proposal > 0)
        & ~opposite
    )
    rows = rows.withColumn("proposal", F.when(allowed, proposal)).withColumn("opposite", opposite)

    def best(until: int) -> Column:
        """The stop from proposals up to so many bars before."""
        frame = by_trade.rowsBetween(Window.unboundedPreceding, -until)
        extreme = by_sign(d, F.max("proposal").over(frame), F.min("proposal").over(frame))
        return by_sign(d, F.greatest("stop", extreme), F.least("stop", extreme))

    rows = rows.withColumn("stop_before", best(2)).withColumn("stop_now", best(1))
    rows = rows.withColumn("exit_due", F.coalesce(F.lag("opposite").over(by_trade), F.lit(False)))
    o, later = F.col("o"), F.col("held") > 0
    beyond = lambda price, stop: d * (price - stop) <= 0
    gap = later & (F.col("status") != COMPLETE)
    worst, best_price = by_sign(d, F.col("l"), F.col("h")), by_sign(d, F.col("h"), F.col("l"))
    stop_hit, target_hit = d * (worst - F.col("stop_now")) <= 0, d * (best_price - F.col("p1")) >= 0

    def event(reason: str, reference: Column, intrabar: bool = False, both: Column | None = None) -> Column:
        return F.struct(
            F.lit(reason).alias("reason"), reference.alias("reference"), F.lit(intrabar).alias("intrabar"),
            (F.lit(False) if both is None else both).alias("both"),
        )

    none = F.lit(None).cast("double")
    found = (
        F.when(gap, event("UNRESOLVED_DATA_GAP", none))
        .when(later & beyond(o, F.col("stop_before")), event("STOP", o))
        .when(later & (d * (o - F.col("p1")) >= 0), event("TARGET", o))
        .when(later & F.col("exit_due"), event("EXIT_STRUCTURE", o))
        .when(F.col("held") >= rules.holding, event("TIME_EXIT", o))
        .when(later & (F.col("t0") >= F.col("last_t0")), event("END_OF_SEGMENT", o))
        .when(later & beyond(o, F.col("stop_now")), event("STOP", o))
        .when(stop_hit, event("STOP", F.col("stop_now"), True, target_hit))
        .when(target_hit, event("TARGET", F.col("p1"), True))
    )
    return rows.withColumn("event", found)


def trades(entered: DataFrame, observed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Filled calls with their exit and economics; an unresolved trade has no result, not a zero."""
    rows = path(entered.filter("entry_outcome = 'FILLED'"), observed, rules).filter("event is not null")
    first = rows.groupBy("series", "leg_id").agg(F.min_by(F.struct("event", "t0", "t1", "held", "stop_now"), "t0").alias("x"))
    met = entered.filter("entry_outcome = 'FILLED'").join(first, ["series", "leg_id"], "left")
    exit_ = F.col("x.event")
    exit_at = F.when(exit_["intrabar"], F.col("x.t1")).otherwise(F.col("x.t0"))
    rows = met.select(
        "series", "leg_id", "d", "qty", "entry", "reference", "risk0", F.col("p1").alias("target"), F.col("stop").alias("stop0"),
        F.col("ended_at").alias("entry_at"), exit_["reason"].alias("reason"), exit_["reference"].alias("exit_reference"),
        exit_["both"].alias("both"), exit_at.alias("exit_at"), F.col("x.stop_now").alias("final_stop"),
    )
    return economics(rows, rules)


def gated(decided: DataFrame, done: DataFrame) -> DataFrame:
    """Legs through the one slot of their series: a leg that is filled holds it until its exit, another until its end.

    What starts while the slot is held is SKIPPED_BUSY and has no trade. A trade that a data gap leaves unresolved halts
    its series: legs that start after the gap are NOT_EVALUATED.
    """
    trade = done.select("series", "leg_id", "entry_at", "exit_at", "reason", "net", F.lit(True).alias("filled"))
    met = decided.join(trade, ["series", "leg_id"], "left")
    halts = F.coalesce(F.col("reason") == "UNRESOLVED_DATA_GAP", F.lit(False)) | (F.col("filled") & F.col("exit_at").isNull())
    until = F.when(F.col("filled"), F.when(~halts, F.col("exit_at"))).otherwise(F.col("ended_at"))
    held = one_slot(met.withColumn("until", until), "leg_t1", "until", F.col("recognized"))
    taken = F.col("slot") == "TAKEN"
    gap = F.min(F.when(taken & halts, F.col("exit_at"))).over(Window.partitionBy("series"))
    late = ~taken & (F.col("leg_t1") > gap)
    out = held.withColumn("slot", F.when(late, "NOT_EVALUATED").otherwise(F.col("slot")))
    return out.select("*", *[F.when(taken, F.col(c)).alias(f"taken_{c}") for c in ("entry_at", "exit_at", "reason", "net")])


def by_exit(trades: DataFrame) -> DataFrame:
    """Trades by exit reason and by where the stop at the exit came from: INITIAL or TRAILED."""
    origin = F.when(F.col("final_stop") == F.col("stop0"), "INITIAL").when(F.col("final_stop").isNotNull(), "TRAILED")
    return trades.groupBy("reason", origin.alias("stop_origin")).agg(
        F.count(F.lit(1)).alias("n"), F.count("net").alias("resolved"), strict_sum(F.col("net")).alias("net"), F.avg("net_over_risk").alias("mean_over_risk")
    )


def economics(trades: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Result, fees and slippage of each trade; ``net`` is null where there is no exit price. Stress reprices it."""
    d, q = F.col("d"), F.col("qty")

    def net(entry: Column, slippage: float, fee: float, reference: Column) -> Column:
        exit_price = reference * (1 - d * slippage)
        return d * q * (exit_price - entry) - fee * q * entry - fee * q * exit_price

    x = F.col("exit_reference") * (1 - d * rules.slippage)
    stressed = F.col("reference") * (1 + d * rules.stress_slippage)
    return (
        trades.withColumn("exit", x)
        .withColumn("price_pnl", d * q * (x - F.col("entry")))
        .withColumn("reference_pnl", d * q * (F.col("exit_reference") - F.col("reference")))
        .withColumn("fees", rules.fee * q * (F.col("entry") + x))
        .withColumn("net", net(F.col("entry"), rules.slippage, rules.fee, F.col("exit_reference")))
        .withColumn("net_target_first", F.when(F.col("both"), net(F.col("entry"), rules.slippage, rules.fee, F.col("target"))))
        .withColumn("stress_net", net(stressed, rules.stress_slippage, rules.stress_fee, F.col("exit_reference")))
        .withColumn("net_over_risk", F.when(q * F.col("risk0") > 0, F.col("net") / (q * F.col("risk0"))))
    )


def funding(trades: DataFrame, rates: DataFrame, marks: DataFrame, bucket: int) -> DataFrame:
    """Holding costs of each trade: rates with entry < tau <= exit, valued at the mark of the minute before.

    Rates within a minute of entry or exit are ambiguous: the total says what the rule counts, and low and high what
    the other choice would change. A counted rate without a mark makes the total unknown.
    """
    spans = trades.filter("exit_at is not null").select("series", "leg_id", "d", "qty", "entry_at", "exit_at")
    wide = spans.withColumn("lo", F.col("entry_at") - MINUTE).withColumn("hi", F.col("exit_at") + MINUTE)
    met = interval_join(rates, wide, ["series"], "tau", "lo", "hi", bucket)
    tau = F.col("tau")
    met = met.withColumn("mark_at", tau - F.pmod(tau, F.lit(MINUTE)) - MINUTE).join(marks, ["series", "mark_at"], "left")
    counted = (tau > F.col("entry_at")) & (tau <= F.col("exit_at"))
    near = (F.abs(tau - F.col("entry_at")) < MINUTE) | (F.abs(tau - F.col("exit_at")) < MINUTE)
    cash = -F.col("d") * F.col("qty") * F.col("mark") * F.col("rate")
    other = F.when(counted, -cash).otherwise(cash)
    zero = F.lit(0.0)
    rows = met.filter(counted | near).withColumn("cash", cash).withColumn("counted", counted).withColumn("near", near).withColumn("other", other)
    found = rows.groupBy("series", "leg_id").agg(
        strict_sum(F.when(F.col("counted"), F.col("cash")).otherwise(zero)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("near"), F.least(zero, F.col("other")))), zero).alias("low"),
        F.coalesce(F.sum(F.when(F.col("near"), F.greatest(zero, F.col("other")))), zero).alias("high"),
        F.count_if("counted").alias("events"),
    )
    return spans.select("series", "leg_id").join(found, ["series", "leg_id"], "left").select(
        "series", "leg_id", F.when(F.col("events").isNull(), zero).otherwise(F.col("total")).alias("funding"),
        F.coalesce("low", zero).alias("funding_low"), F.coalesce("high", zero).alias("funding_high"), F.coalesce("events", F.lit(0)).alias("funding_events"),
    )


def value_path(entered: DataFrame, trades: DataFrame, observed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Marked value of each open trade at each bar's close, entry fee taken."""
    ended = trades.select("series", "leg_id", "exit_at")
    rows = path(entered.filter("entry_outcome = 'FILLED'"), observed, rules).join(ended, ["series", "leg_id"])
    value = F.col("d") * F.col("qty") * (F.col("c") - F.col("entry")) - rules.fee * F.col("qty") * F.col("entry")
    z = F.col("d") * (F.col("c") - F.col("entry")) / F.col("risk0")
    return rows.filter(F.col("t1") < F.coalesce("exit_at", F.lit(1 << 62))).select("series", "leg_id", "t1", value.alias("value"), z.alias("z"))
