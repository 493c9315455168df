"""The registered queries: operators over the tables, in flat columns, doubles rounded to six places."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import measures, scalars
from tidemark.functions.scalars import DAY, HOUR, MINUTE, epoch_ms
from tidemark.operators import asof, bars, decisions, ledger, lifecycle, observe, outcomes, population, quantiles, replay, scan, summary, verify
from tidemark.sources.shared import materialize

WIDTH = 90 * MINUTE
DAY_BARS = DAY // WIDTH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def ticks(spark: SparkSession, sf_dir: str, series: Column | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        (F.col("event_type") if series is None else series).alias("series"),
        epoch_ms(F.col("ts")).alias("t"),
        F.col("ts").alias("at"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("qty"),
    )


def typed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.aggregate(ticks(spark, sf_dir), WIDTH)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.aggregate(ticks(spark, sf_dir), DAY)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.observe(typed_bars(spark, sf_dir))


def observed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(observed(spark, sf_dir))


def bars_ohlcv_45m(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bars.aggregate(ticks(spark, sf_dir, F.lit("ALL")), 45 * MINUTE)
    return found.filter("status = 'COMPLETE'").select("series", "t0", "ticks", *r6("o", "h", "l", "c", "v"))


def bars_dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_bars(spark, sf_dir).select("series", "t0", "t1", "status", "ticks", *r6("o", "h", "l", "c"))


def bars_regrouped_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.regroup(typed_bars(spark, sf_dir), DAY).select("series", "t0", "status", "ticks", *r6("o", "h", "l", "c", "v"))


def daily_partial_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.daily_partial(typed_bars(spark, sf_dir)).select("series", "t0", *r6("o", "h", "l", "c"), "partial")


def bar_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.segments(typed_bars(spark, sf_dir)).select("series", "t0", "segment", "pos")


def tr_mean_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observe.volatility(bars.segments(typed_bars(spark, sf_dir)))
    return found.select("series", "t0", *r6("tr", "a", "a_over_c"), "tr_r", "a_r")


def sma_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observe.averages(observe.volatility(bars.segments(typed_bars(spark, sf_dir))))
    names = ("sma_fast", "sma_slow", "dist", "slope", "place")
    return found.select("series", "t0", *r6(*names), *[f"{n}_r" for n in names])


def average_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observe.averages(observe.volatility(bars.segments(typed_bars(spark, sf_dir))))
    return found.select("series", "t0", "cross", "cross_r")


def volume_ratio_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observe.volumes(bars.segments(typed_bars(spark, sf_dir)))
    return found.select("series", "t0", *r6("v_median", "v_ratio"), "v_ratio_r")


def pivots_2_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observe.pivots(bars.segments(typed_bars(spark, sf_dir)))
    return found.select("series", "t0", "high_check", "low_check", "pivot_kind", *r6("pivot_price"), "candidate_t0")


def structure_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observe.structure(observe.pivots(bars.segments(typed_bars(spark, sf_dir))))
    names = ("high_last", "high_before", "low_last", "low_before")
    return found.filter("status = 'COMPLETE'").select("series", "t0", "structure", "structure_r", *r6(*names))


def alternating_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observe.alternation(observe.pivots(bars.segments(typed_bars(spark, sf_dir))))
    return found.select(
        "series", "t1", "kind", "action", "version",
        F.round("price", 6).alias("price"),
        F.col("p0.c0").alias("p0_t0"), F.col("p1.c0").alias("p1_t0"),
        F.round("p0.price", 6).alias("p0_price"), F.round("p1.price", 6).alias("p1_price"),
    )


def anchor_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("series", "t1", "version", "anchors_r", *r6("u", "r"))


def anchor_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observe.geometry(observed(spark, sf_dir))
    return found.select("series", "t1", "version", "kind", *r6("ratio", "price", "dist"))


def levels_and_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = observe.crossings(observe.levels(observed(spark, sf_dir), daily_bars(spark, sf_dir)))
    return found.select("series", "t1", "kind", "direction", *r6("price", "previous", "c"))


def observation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observed_once(spark, sf_dir)
    crossed = observe.crossings(observe.levels(seen, daily_bars(spark, sf_dir)))
    found = observe.events(seen, observe.alternation(seen), crossed)
    return found.groupBy("series", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("known_at").alias("first_known"), F.max("known_at").alias("last_known"),
        F.max(F.col("known_at") - F.col("event_at")).alias("longest_wait"),
    )


def measure_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["tr", "a", "sma_fast", "sma_slow", "dist", "slope", "place", "cross", "v_ratio", "structure"]
    found = observe.availability(observed(spark, sf_dir), names)
    return found.groupBy("measure", F.coalesce("reason", F.lit("AVAILABLE")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def flatten_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observed(spark, sf_dir)
    nested = seen.select(
        "series", "t1",
        *[F.struct(F.round(n, 6).alias("v"), F.col(f"{n}_r").alias("r")).alias(n) for n in ("a", "dist", "slope")],
    )
    return summary.flatten(nested)


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = observe.structure(observe.pivots(bars.segments(daily_bars(spark, sf_dir))))
    return outcomes.daily_relation(observed(spark, sf_dir), days)


def daily_relation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ["UP", "DOWN", "MIXED", "UNAVAILABLE"]
    counts = _related(spark, sf_dir).groupBy("s_bar").pivot("s_day", states).agg(F.count(F.lit(1)))
    return counts.select("s_bar", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in states])


def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir).groupBy("series", "s_bar", "relation").agg(F.count(F.lit(1)).alias("n"))


def _future(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.forward(observed(spark, sf_dir), DAY_BARS)


def forward_outcomes_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("max_high", "min_low", "close_after", "final", "up", "down")
    found = _future(spark, sf_dir)
    return found.select("series", "t1", "valid", "in_range", "future_complete", "a_status", *r6(*names))


def right_censoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _future(spark, sf_dir).select("series", F.array_join("flags", "+").alias("flags"))
    return found.groupBy("series", "flags").agg(F.count(F.lit(1)).alias("n"))


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observed_once(spark, sf_dir)
    starts = seen.filter("structure in ('UP', 'DOWN') and a > 0").withColumn(
        "d", F.when(F.col("structure") == "UP", 1).otherwise(-1)
    )
    marker = F.col("d") * F.col("a")
    starts = starts.select("series", "t0", "t1", "d", "c", "a", (F.col("c") + marker).alias("f"), (F.col("c") - marker).alias("g"))
    return outcomes.normalised(outcomes.first_touch(starts, typed_bars(spark, sf_dir), DAY_BARS))


def first_touch_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("max_high", "min_low", "final", "favourable", "adverse")
    return _touched(spark, sf_dir).select(
        "series", "t1", "d", "class", "bars", "f_bar", "g_bar", "max_high_bar", "min_low_bar", *r6(*names)
    )


def outcome_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Describe the outcomes by month and structure, with pooled totals for each level."""
    found = _future(spark, sf_dir).select(
        scalars.month_of(F.col("t1")).alias("month"), F.coalesce("structure", F.lit("UNAVAILABLE")).alias("state"), "final"
    )
    return summary.grouped(found, ["month", "state"], "final", (0.1, 0.5, 0.9))


def outcome_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each series and direction, the most contrary outcome and the first one."""
    found = _future(spark, sf_dir).filter("structure in ('UP', 'DOWN') and final is not null")
    sign = F.when(F.col("structure") == "UP", 1).otherwise(-1)
    return found.groupBy("series", "structure").agg(
        F.min_by("t1", F.struct((sign * F.col("final")).alias("x"), "t1")).alias("contrary"), F.min("t1").alias("first")
    )


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = observed_once(spark, sf_dir)
    return materialize(population.versions(observe.alternation(seen), seen)), seen


def movement_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _versions(spark, sf_dir)
    return found.select(
        "series", "version_id", "group_id", "d", "active_from", "retired_at", "retire_reason", "action", *r6("length")
    )


def attempts_rearm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = _versions(spark, sf_dir)
    tried = population.attempts(found, seen)
    return tried.select("series", "group_id", "version_id", "ordinal", "d", "t1", "bars_since_p1", "counter_closes", *r6("c"))


def attempt_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = _versions(spark, sf_dir)
    back = population.reactions(population.attempts(found, seen), seen)
    return back.select("series", "group_id", "ordinal", "t1", "p1_touched", *r6("extreme", "depth"))


def attempt_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = _versions(spark, sf_dir)
    each = population.attempts(found, seen).groupBy("series", "group_id").agg(F.count(F.lit(1)).alias("attempts"))
    return each.groupBy("attempts").agg(F.count(F.lit(1)).alias("groups"))


def attempt_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = _versions(spark, sf_dir)
    tried = population.attempts(found, seen).select("series", "t1", "d", "group_id")
    state = seen.select("series", "t1", "structure", "dist", "slope")
    met = tried.join(state, ["series", "t1"]).withColumn("profile", population.joint_profile(F.col("d")))
    both = met.groupingSets([["d"], ["d", "profile"]], "d", "profile")
    return both.agg(
        F.grouping("profile").cast("int").alias("pooled"), F.count(F.lit(1)).alias("attempts"), F.countDistinct("series", "group_id").alias("groups")
    )


def joint_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observed(spark, sf_dir).withColumn("d", F.explode(F.array(F.lit(1), F.lit(-1))))
    return seen.groupBy("series", "d", population.joint_profile(F.col("d")).alias("profile")).agg(F.count(F.lit(1)).alias("n"))


def nearest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    leveled = observe.levels(observed(spark, sf_dir), daily_bars(spark, sf_dir)).filter("c is not null")
    found = population.nearest_levels(leveled, F.lit(1))
    return found.select(
        "series", "t1",
        F.col("ahead.kind").alias("ahead_kind"), F.round("ahead.gap", 6).alias("ahead_gap"),
        F.col("behind.kind").alias("behind_kind"), F.round("behind.gap", 6).alias("behind_gap"),
    )


def version_overlap_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _versions(spark, sf_dir)
    return population.overlap(found.select("series", "active_from", "retired_at"), ["series"], "active_from", "retired_at", 64 * DAY)


def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the last confirmed pivot of its series that was known by then."""
    seen = observe.pivots(bars.segments(typed_bars(spark, sf_dir))).filter("pivot_kind is not null")
    facts = seen.select("series", F.col("t1").alias("known_at"), F.col("pivot_kind").alias("kind"), F.round("pivot_price", 6).alias("price"))
    asked = ticks(spark, sf_dir).select("series", "t", F.round("price", 6).alias("paid"))
    return asof.asof_join(asked, facts, ["series"], "t", "known_at", "pivot_", 8 * DAY)


def visible_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last pivot of each series that was known at the middle of the month."""
    seen = observe.pivots(bars.segments(typed_bars(spark, sf_dir))).filter("pivot_kind is not null")
    facts = seen.select("series", F.col("t1").alias("known_at"), F.col("pivot_kind").alias("kind"), F.round("pivot_price", 6).alias("price"))
    return asof.snapshot(facts, 1_705_320_000_000, ["series"])


def last_known_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.last_known(typed_bars(spark, sf_dir), ["series"], "t0", "c", "known", scan.BLOCK_ROWS * WIDTH).select("series", "t0", *r6("known"))


def rate_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates (hourly means of one series) that fall into each version's life."""
    found, _ = _versions(spark, sf_dir)
    rates = ticks(spark, sf_dir).groupBy("series", scalars.interval_start(F.col("t"), HOUR).alias("tau")).agg(F.avg("price").alias("rate"))
    met = asof.interval_join(rates, found.select("series", "version_id", "active_from", "retired_at"), ["series"], "tau", "active_from", "retired_at", DAY)
    counted = met.filter("tau > active_from")
    return counted.groupBy("series", "version_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rate"), 6).alias("total"))


def series_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of each series as a schedule: ticks whose distance is over an hour, and repeated minutes."""
    at = Window.partitionBy("series").orderBy("t", "at")
    seen = ticks(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(at))
    return seen.groupBy("series").agg(
        F.count_if(F.col("gap") > HOUR).alias("long_gaps"), F.count_if(F.col("gap") < MINUTE).alias("within_a_minute"),
        F.max("gap").alias("longest"), (F.count_if(F.col("gap") > 12 * HOUR) == 0).alias("certified"),
    )


def first_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bar of each category, every declared category there even if empty."""
    seen = _future(spark, sf_dir)
    hits = {
        "UP_COMPLETE": "structure = 'UP' and future_complete",
        "DOWN_COMPLETE": "structure = 'DOWN' and future_complete",
        "CENSORED": "array_contains(flags, 'RIGHT_CENSORED')",
        "GAP": "array_contains(flags, 'GAP')",
        "NEVER": "a < 0",
    }
    return summary.first_of_each(seen.select("series", "t1", "structure", "future_complete", "flags", "a"), hits, ["t1", "series"])


def describe_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles.described(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), (0.1, 0.25, 0.5, 0.75, 0.9))
    return found.select("l_returnflag", "l_linestatus", "n", *r6("mean", "min", "max", "p10", "p25", "p50", "p75", "p90"))


def grouping_sets_domain_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        scalars.year_of(epoch_ms(F.col("o_orderdate"))).alias("year"), F.col("o_orderstatus").alias("state"), "o_totalprice"
    )
    return summary.filled_counts(orders, "year", "state", ["F", "O", "P", "X"], "o_totalprice")


def _net() -> Column:
    return F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))


def _day_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    day = scalars.floor_day(epoch_ms(F.col("l_shipdate"))).alias("day")
    return items.groupBy(F.col("l_returnflag").alias("book"), day).agg(F.round(F.sum(_net()), 4).alias("net"))


def trade_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("book"), _net().alias("net"))
    return summary.trade_stats(items, ["book"], "net")


def drawdown_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.drawdown(_day_nets(spark, sf_dir), ["book"], "day", "net")


def losing_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.losing_streak(_day_nets(spark, sf_dir), ["book"], "day", "net")


def concentration_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.concentration(_day_nets(spark, sf_dir), ["book"], "net", "day", 5)


def cashflow_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated flows of one trade: fee at the order, result at shipping, tax at the end of the shipping month."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    met = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    bought, shipped = epoch_ms(F.col("o_orderdate")), epoch_ms(F.col("l_shipdate"))
    price = F.col("l_extendedprice")
    flows = F.array(
        F.struct(scalars.month_of(bought).alias("month"), F.lit("FEE").alias("kind"), (-0.001 * price).alias("amount")),
        F.struct(scalars.month_of(shipped).alias("month"), F.lit("RESULT").alias("kind"), (price * F.col("l_discount")).alias("amount")),
        F.struct(scalars.month_of(shipped).alias("month"), F.lit("TAX").alias("kind"), (-price * F.col("l_tax")).alias("amount")),
    )
    rows = met.select(F.explode(flows).alias("f"))
    return rows.groupBy("f.month", "f.kind").agg(F.round(F.sum("f.amount"), 2).alias("amount"), F.count(F.lit(1)).alias("n"))


def null_poisoning_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that are unknown where one order's amount is withheld."""
    orders = table(spark, sf_dir, "orders")
    known = F.when(~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 7 == 0)), F.col("o_totalprice"))
    month = scalars.month_of(epoch_ms(F.col("o_orderdate"))).alias("month")
    return orders.groupBy(month, "o_orderpriority").agg(
        F.round(measures.strict_sum(known), 2).alias("total"), F.count_if(known.isNull()).alias("withheld")
    )


def stock_flow_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open versions by day: start + births - ends = end."""
    found, _ = _versions(spark, sf_dir)
    return summary.stock_flow(found.select("series", "active_from", "retired_at"), ["series"], "active_from", "retired_at", DAY)


def duration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations from order to shipping: reached, not reached by the end of the data, or never."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    first = items.groupBy("l_orderkey").agg(F.min(epoch_ms(F.col("l_shipdate"))).alias("shipped"))
    met = orders.join(first, orders["o_orderkey"] == first["l_orderkey"], "left")
    bought = epoch_ms(F.col("o_orderdate"))
    return summary.durations(met.select("o_orderstatus", bought.alias("born"), "shipped"), ["o_orderstatus"], "born", "shipped", DAY)


def duplicate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are single, repeated alike, or repeated with different values."""
    items = table(spark, sf_dir, "lineitem")
    rest = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    each = items.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(rest).alias("kinds"))
    state = F.when(F.col("n") == 1, "SINGLE").when(F.col("kinds") == 1, "IDENTICAL").otherwise("DISCORDANT")
    return each.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"))


def partition_pruned_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month, as a filter on the column itself so that it reaches the scan."""
    orders = table(spark, sf_dir, "orders")
    inside = (F.col("o_orderdate") >= F.expr("timestamp_ntz'1995-03-01 00:00:00'")) & (F.col("o_orderdate") < F.expr("timestamp_ntz'1995-04-01 00:00:00'"))
    return orders.filter(inside).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def step_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    value = (F.col("l_extendedprice").cast("decimal(18,2)") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).cast("decimal(18,2)")
    found = items.select("l_orderkey", "l_linenumber", "l_returnflag", value.alias("value"))
    down = scalars.floor_to_step(F.col("value"), Decimal("0.25"))
    up = scalars.ceil_to_step(F.col("value"), Decimal("0.25"))
    return found.groupBy("l_returnflag").agg(
        F.sum(down).cast("double").alias("down"), F.sum(up).cast("double").alias("up"), F.count_if(down == F.col("value")).alias("exact")
    )


def interval_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of 50 minutes whose origin lies after most ticks."""
    origin = 1_705_000_020_000
    start = scalars.interval_start(F.col("t"), 50 * MINUTE, origin).alias("start")
    return ticks(spark, sf_dir).groupBy("series", start).agg(F.count(F.lit(1)).alias("n"))


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ticks(spark, sf_dir).select(scalars.iso(F.col("t")).alias("text"), scalars.month_of(F.col("t")).alias("month"), F.col("t"))
    return found.select("text", "month", (scalars.parse_utc(F.col("text")) == F.floor(F.col("t") / 1000) * 1000).alias("same")).groupBy("text", "month", "same").agg(F.count(F.lit(1)).alias("n"))


def semi_anti_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with and without an attempt."""
    found, seen = _versions(spark, sf_dir)
    groups = found.select("series", "group_id").distinct()
    tried = population.attempts(found, seen).select("series", "group_id")
    with_one = groups.join(tried, ["series", "group_id"], "left_semi").withColumn("tried", F.lit(True))
    without = groups.join(tried, ["series", "group_id"], "left_anti").withColumn("tried", F.lit(False))
    return with_one.unionByName(without).groupBy("series", "tried").agg(F.count(F.lit(1)).alias("groups"))


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two states of a register: gone, added and changed keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    before = orders.filter("o_orderkey % 11 <> 0")
    after = orders.filter("o_orderkey % 13 <> 0").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 17 == 0, "CHANGED").otherwise(F.col("o_orderpriority"))
    )
    return summary.register_diff(before, after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def reconcile_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose states do not add up to their bars: the cells of UP are counted one short, so those of them that have any."""
    seen = observed(spark, sf_dir).withColumn("state", F.coalesce("structure", F.lit("UNAVAILABLE")))
    cells = seen.groupBy("series", "state").agg(F.count(F.lit(1)).alias("n"))
    short = cells.withColumn("n", F.col("n") - (F.col("state") == "UP").cast("long"))
    return summary.differing_totals(short, seen.groupBy("series").agg(F.count(F.lit(1)).alias("n")), ["series"], "n")


def downsampled_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 28th day of the running result, and the points where it is lowest."""
    found = summary.drawdown_path(_day_nets(spark, sf_dir), ["book"], "day", "net")
    lowest = Window.partitionBy("book")
    kept = found.withColumn("low", F.min("equity").over(lowest)).filter((F.pmod(F.col("day"), F.lit(28 * DAY)) == 0) | (F.col("equity") == F.col("low")))
    return kept.select("book", "day", *r6("equity"))


#: Limits wide enough for the tables' ticks, which jump about far more than a market does.
LOOSE = decisions.Rules(amplitude=0.2, depth_min=0.1, depth_max=1.4, reward_risk=0.05)


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = observed_once(spark, sf_dir)
    found = materialize(decisions.legs(observe.alternation(seen), seen, LOOSE))
    return decisions.decisions(found, seen, LOOSE), seen


def leg_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _decided(spark, sf_dir)
    return found.select("series", "leg_id", "leg_t1", "d", "leg_bars", "outcome", "ended_at", "counter", *r6("depth", "stop", "risk", "gain", "entry_bound"))


def slot_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which legs a single slot of each series would take; what isn't recognized does not hold it."""
    found, _ = _decided(spark, sf_dir)
    taken = decisions.one_slot(found, "leg_t1", "ended_at", F.col("recognized"))
    return taken.select("series", "leg_id", "leg_t1", "outcome", "slot")


def ledger_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = _decided(spark, sf_dir)
    done = ledger.trades(materialize(ledger.entries(found, seen, LOOSE)), seen, LOOSE)
    names = ("entry", "exit", "final_stop", "price_pnl", "fees", "net", "net_target_first", "stress_net", "net_over_risk")
    return done.select("series", "leg_id", "entry_at", "exit_at", "reason", "both", *r6(*names))


def _trades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found, seen = _decided(spark, sf_dir)
    found = materialize(found)
    return found, materialize(ledger.trades(materialize(ledger.entries(found, seen, LOOSE)), seen, LOOSE))


def gated_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leg with what the slot of its series made of it, and the trade of those that took it."""
    held = ledger.gated(*_trades(spark, sf_dir))
    return held.select("series", "leg_id", "leg_t1", "outcome", "slot", "taken_entry_at", "taken_exit_at", "taken_reason", *r6("taken_net"))


def exit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades by the reason of their exit and the origin of their stop."""
    return ledger.by_exit(_trades(spark, sf_dir)[1]).select("reason", "stop_origin", "n", "resolved", *r6("net", "mean_over_risk"))


def entry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = _decided(spark, sf_dir)
    return ledger.entries(found, seen, LOOSE).groupBy("series", "entry_outcome").agg(F.count(F.lit(1)).alias("n"))


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return items.select(
        F.col("l_partkey").alias("part"), epoch_ms(F.col("l_shipdate")).alias("at"), "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("supp"),
        side.alias("side"), F.col("l_quantity").alias("qty"), price.alias("price"), (F.col("l_extendedprice") * 0.001).alias("fee"),
    )


def average_cost_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replay.average_cost(_fills(spark, sf_dir), ["part"], ["at", "l_orderkey", "l_linenumber", "supp"])
    return done.select("part", "closes", *[F.round(c, 2).alias(c) for c in ("qty", "avg_price", "realized", "fees", "net")])


def replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order books folded from the event log of each user."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("click", "ORDER"), ("view", "FILL"), ("purchase", "STOP"), ("error", "CANCEL"), ("signup", "MODE")) for x in p]), F.col("event_type"))
    events = table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(50)).alias("book"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.pmod("user_id", F.lit(3)).cast("string").alias("order_id"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.lit(1.0).alias("qty"), F.col("value").alias("price"),
    )
    return replay.order_book(events, ["book"])


def _every(n: int) -> Column:
    """Each n-th place of the grid of bars."""
    return F.pmod(F.floor(F.col("t0") / WIDTH), F.lit(n)) == 0


def bar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults that are put into every 97th, 101st and 103rd bar, as the rules find them."""
    faulty = typed_bars(spark, sf_dir).withColumn("h", F.when(_every(97), F.col("l") - 1).otherwise(F.col("h")))
    faulty = faulty.withColumn("t1", F.when(_every(101), F.col("t0")).otherwise(F.col("t1")))
    return verify.bar_violations(faulty.withColumn("status", F.when(_every(103), "UNKNOWN").otherwise(F.col("status"))))


def observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults that are put into observations, as the rules find them: reasons beside values, values gone, early pivots, lost segments."""
    seen = observed(spark, sf_dir)
    seen = seen.withColumn("tr_r", F.when(_every(89), "FAULT").otherwise(F.col("tr_r")))
    seen = seen.withColumn("dist", F.when(_every(83), F.lit(None)).otherwise(F.col("dist")))
    seen = seen.withColumn("candidate_t1", F.when(_every(7), F.col("t1")).otherwise(F.col("candidate_t1")))
    seen = seen.withColumn("segment", F.when(_every(79), F.lit(None)).otherwise(F.col("segment")))
    return verify.observation_violations(seen, ["tr", "a", "sma_fast", "sma_slow", "dist", "slope", "place", "cross", "v_ratio", "structure"])


def outcome_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of the next day by frames and by joined bars: a fault in every 53rd frame, and nothing else, differs."""
    seen = observed_once(spark, sf_dir)
    starts = seen.filter("c is not null").select("series", "t0", "t1", F.lit(1).alias("d"), "c", "a", F.lit(None).cast("double").alias("f"), F.lit(None).cast("double").alias("g"))
    joined = outcomes.first_touch(starts, typed_bars(spark, sf_dir), DAY_BARS).filter("first_gap is null")
    framed = outcomes.forward(seen, DAY_BARS).filter("future_complete and c is not null")
    framed = framed.withColumn("max_high", F.col("max_high") + F.when(_every(53), 1).otherwise(0))
    return verify.disagreements(framed, joined.withColumnRenamed("close_last", "close_after"), ["series", "t1"], ["max_high", "min_low", "close_after"])


def version_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as they were known in the middle of the month: what ended later is still open."""
    found, _ = _versions(spark, sf_dir)
    known = population.known_versions(found, 1_705_320_000_000)
    return known.select("series", "version_id", "d", "active_from", "retired_at", "retire_reason")


def attempt_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the sequence to attempts, one row for each step."""
    found, seen = _versions(spark, sf_dir)
    sequence = observe.alternation(seen)
    tried = population.attempts(found, seen)
    steps = [
        ("SEQUENCE", sequence), ("ACCEPTED", sequence.filter("action <> 'KEEP'")), ("VERSIONS", found), ("GROUPS", found.select("series", "group_id").distinct()),
        ("ATTEMPTS", tried), ("GROUPS_TRIED", tried.select("series", "group_id").distinct()),
    ]
    return summary.funnel(steps)


def attempt_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known at each attempt: profile, day, levels ahead and behind, signed measures, how far back price had come."""
    found, seen = _versions(spark, sf_dir)
    tried = population.attempts(found, seen)
    days = observe.structure(observe.pivots(bars.segments(daily_bars(spark, sf_dir))))
    state = outcomes.daily_relation(observe.levels(seen, daily_bars(spark, sf_dir)).drop("day_end"), days)
    made = population.snapshots(tried, population.reactions(tried, seen), state)
    names = ("d_dist", "d_slope", "d_place", "v_ratio", "length_over_a", "to_p1", "to_extreme", "ahead_gap", "behind_gap", "depth")
    return made.select("series", "group_id", "ordinal", "t1", "d", "profile", "s_day", "cross_side", "anchors_side", "ahead_kind", "behind_kind", *r6(*names))


def attempt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and groups by side and contact class, with the final way described."""
    found, seen = _versions(spark, sf_dir)
    tried = population.attempts(found, seen).select("series", "group_id", "ordinal", "t0", "t1", "d", "c")
    met = tried.join(seen.select("series", "t1", "a"), ["series", "t1"]).filter("a > 0")
    marker = F.col("d") * F.col("a")
    starts = met.withColumn("f", F.col("c") + marker).withColumn("g", F.col("c") - marker)
    after = outcomes.normalised(outcomes.first_touch(starts, typed_bars(spark, sf_dir), DAY_BARS))
    rows = starts.select("series", "group_id", "t1", "d").join(after.select("series", "t1", "d", "class", "final"), ["series", "t1", "d"])
    rows = rows.withColumn("final", F.when(F.col("class").isNotNull(), F.col("final"))).withColumn("class", F.coalesce("class", F.lit("INCOMPLETE")))
    cells = rows.groupBy("d", "class").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("series", "group_id").alias("groups"))
    cells = cells.join(quantiles.described(rows, ["d", "class"], F.col("final"), (0.1, 0.5, 0.9)), ["d", "class"])
    shares = measures.share(F.col("attempts"), F.sum("attempts").over(Window.partitionBy("d")))
    return cells.withColumn("share", shares).select("d", "class", "attempts", "groups", "n", *r6("share", "mean", "min", "max", "p10", "p50", "p90"))


def value_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked value of every open trade: how far it went either way while it was held."""
    found, seen = _decided(spark, sf_dir)
    entered = materialize(ledger.entries(found, seen, LOOSE))
    path = ledger.value_path(entered, ledger.trades(entered, seen, LOOSE), seen, LOOSE)
    return path.groupBy("series", "leg_id").agg(
        F.count(F.lit(1)).alias("bars"), F.round(F.min("value"), 6).alias("lowest"), F.round(F.max("value"), 6).alias("highest"),
        F.round(F.min("z"), 6).alias("z_lowest"), F.round(F.max("z"), 6).alias("z_highest"),
    )


def holding_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates every eight hours at the price of the minute before, counted while a trade is held."""
    found, seen = _decided(spark, sf_dir)
    done = ledger.trades(materialize(ledger.entries(found, seen, LOOSE)), seen, LOOSE)
    marks = typed_bars(spark, sf_dir).filter("c is not null").select("series", (F.col("t1") - MINUTE).alias("mark_at"), F.col("c").alias("mark"))
    rates = typed_bars(spark, sf_dir).filter(F.pmod("t1", F.lit(8 * HOUR)) == 0).select("series", F.col("t1").alias("tau"), F.lit(0.0001).alias("rate"))
    paid = ledger.funding(done, rates, marks, DAY)
    return paid.select("series", "leg_id", "funding_events", *r6("funding", "funding_low", "funding_high"))


def period_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes, calls and covered bars of each month and in all."""
    found, seen = _decided(spark, sf_dir)
    month = lambda c: scalars.month_of(F.col(c))
    closes = seen.select(month("t0").alias("month"), (F.col("status") == "COMPLETE").cast("int").alias("covered"), F.lit(0).alias("legs"), F.lit(0).alias("calls"))
    legs = found.select(month("leg_t1").alias("month"), F.lit(None).cast("int").alias("covered"), F.lit(1).alias("legs"), (F.col("outcome") == "CALL").cast("int").alias("calls"))
    rows = closes.unionByName(legs).groupingSets([["month"], []], "month")
    return rows.agg(
        F.grouping("month").cast("int").alias("pooled"), F.count("covered").alias("closes"), F.sum("covered").alias("covered"), F.sum("legs").alias("legs"), F.sum("calls").alias("calls")
    )


def longest_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five versions that were active longest; ties by id."""
    found, _ = _versions(spark, sf_dir)
    life = (F.col("retired_at") - F.col("active_from")).alias("life")
    return found.select("series", "version_id", life).orderBy(F.desc("life"), "series", "version_id").limit(5)


def lifecycle_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Births, ends and stock of the movement log by week."""
    moved = lifecycle.movements(_log(spark, sf_dir)[0])
    ended = F.coalesce("ended", F.lit(1_706_745_600_000))
    return summary.stock_flow(moved.select("series", "born", ended.alias("over")), ["series"], "born", "over", 7 * DAY)


def lifecycle_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each movement was held to be in the middle of the month."""
    return lifecycle.judgement_at(_log(spark, sf_dir)[0], 1_705_320_000_000)


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = observed_once(spark, sf_dir)
    return lifecycle.lifecycle(seen, observe.alternation(seen)), seen


def lifecycle_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _log(spark, sf_dir)
    return found.select("series", "t", "seq", "type", "ref_id", "side", "reason", "condition", *r6("base", "extreme", "anchor"))


def lifecycle_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.movements(_log(spark, sf_dir)[0])


def lifecycle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with faults, as the rules find them: bases of losses and closes moved past the close, every third end left out."""
    log, seen = _log(spark, sf_dir)
    third = F.pmod(F.col("base_t0") / WIDTH, F.lit(3)) == 0
    log = log.filter(~(third & F.col("type").isin("ARCHIVE", "OPEN_AT_END") & (F.col("reason") != "BASE_LOST")))
    away = F.when(F.col("side") == "LONG", 1000).otherwise(-1000)
    moved = F.when(F.col("reason") == "BASE_LOST", F.col("base") - away).when(third & (F.col("type") == "CLOSE"), F.col("base") + away)
    return lifecycle.violations(log.withColumn("base", F.coalesce(moved, "base")), seen)


ALL = {
    f.__name__: f
    for f in (
        bars_ohlcv_45m, bars_dense_grid, bars_regrouped_daily, daily_partial_candles, bar_segments, tr_mean_range, sma_pair,
        average_crosses, volume_ratio_median, pivots_2_2, structure_state, alternating_sequence, anchor_position,
        anchor_geometry, levels_and_crossings, observation_events, measure_availability, flatten_measures,
        daily_relation_matrix, relation_counts, forward_outcomes_24h, right_censoring, first_touch_class, outcome_groups,
        outcome_examples, movement_versions, attempts_rearm, attempt_reactions, attempt_count_histogram, attempt_profiles,
        joint_profile, nearest_levels, version_overlap_peak, asof_snapshot, visible_at, last_known_close, rate_interval_join,
        series_certification, first_per_category, describe_by_group, grouping_sets_domain_fill, trade_stats, drawdown_curve,
        losing_streak, concentration_top5, cashflow_by_month, null_poisoning_sum, stock_flow_periods, duration_status,
        duplicate_policy, partition_pruned_month, step_rounding, interval_bounds, iso_times, semi_anti_activity, changed_rows,
        reconcile_partitions, downsampled_curve, leg_decisions, slot_greedy, ledger_exits, gated_ledger, exit_groups, entry_outcomes,
        average_cost_accounting, replay_state, lifecycle_ledger, lifecycle_movements, lifecycle_violations, bar_violations,
        observation_violations, outcome_cross_check, version_projection, attempt_flow, attempt_snapshots, attempt_cells, value_paths,
        holding_costs, period_table, longest_movements, lifecycle_periods, lifecycle_judgements,
    )
}
