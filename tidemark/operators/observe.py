"""Causal observations of bars: indicators, confirmed pivots, structure, anchors, levels and crossings.

Every column of a bar's row uses bars that end with it or before. Where a value is missing, a column with the suffix
``_r`` says why. What looks back a fixed number of bars is windows over a segment, so a gap resets it. What remembers
without limit (segments, last pivots, the alternating sequence) is running values over blocks of time, and belongs to a
segment by its number; only the version of the sequence and the segment number run on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions.measures import (
    ANCHORS_EQUAL,
    INCOMPLETE_INPUT,
    INSUFFICIENT_HISTORY,
    NO_CONFIRMED_PIVOTS,
    ZERO_DENOMINATOR,
)
from tidemark.functions.scalars import floor_day
from tidemark.operators import asof, scan
from tidemark.operators.bars import COMPLETE, segments, with_previous
from tidemark.sources.shared import materialize


@dataclass(frozen=True)
class Conventions:
    """Lengths of the windows, in bars."""

    tr: int = 20
    fast: int = 20
    slow: int = 50
    lag: int = 4
    volume: int = 20
    side: int = 2
    retracements: tuple[float, ...] = (0.236, 0.382, 0.5, 0.618, 0.786)
    projections: tuple[float, ...] = (1.272, 1.618)


def by_segment() -> WindowSpec:
    """Bars of a segment in order."""
    return Window.partitionBy("series", "segment").orderBy("t0")


def _complete() -> Column:
    return F.col("status") == COMPLETE


def _reason(enough: Column) -> Column:
    return F.when(~_complete(), INCOMPLETE_INPUT).when(~enough, INSUFFICIENT_HISTORY)


def _over_a(name: str, numerator: Column, enough: Column) -> dict[str, Column]:
    """Columns ``name`` = numerator / a, and the reason of whatever is missing."""
    reason = (
        F.when(~_complete(), INCOMPLETE_INPUT)
        .when(~enough, INSUFFICIENT_HISTORY)
        .when(F.col("a").isNull(), F.col("a_r"))
        .when(F.col("a") == 0, ZERO_DENOMINATOR)
    )
    return {f"{name}_r": reason, name: F.when(reason.isNull(), numerator / F.col("a"))}


def volatility(bars: DataFrame, conv: Conventions = Conventions()) -> DataFrame:
    """``tr``, its mean ``a`` over the window, and ``a_over_c``; ``bars`` must have segments."""
    before = F.lag("c").over(by_segment())
    tr = F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before))
    enough = F.col("pos") >= conv.tr + 1
    known = {"tr": F.when(_complete() & before.isNotNull(), tr), "tr_r": _reason(F.col("pos") >= 2)}
    mean = F.avg("tr").over(by_segment().rowsBetween(1 - conv.tr, 0))
    return (
        bars.withColumns(known)
        .withColumns({"a": F.when(enough, mean), "a_r": _reason(enough)})
        .withColumn("a_over_c", F.col("a") / F.col("c"))
    )


def averages(bars: DataFrame, conv: Conventions = Conventions()) -> DataFrame:
    """Fast and slow means, their distance, slope and place of the close in units of ``a``, and their crosses."""
    means = {}
    for name, n in (("sma_fast", conv.fast), ("sma_slow", conv.slow)):
        mean = F.avg("c").over(by_segment().rowsBetween(1 - n, 0))
        means |= {name: F.when(F.col("pos") >= n, mean), f"{name}_r": _reason(F.col("pos") >= n)}
    fast = F.col("sma_fast")
    ratios = (
        _over_a("dist", fast - F.col("sma_slow"), F.col("pos") >= conv.slow)
        | _over_a("slope", fast - F.lag("sma_fast", conv.lag).over(by_segment()), F.col("pos") >= conv.fast + conv.lag)
        | _over_a("place", F.col("c") - fast, F.col("pos") >= max(conv.tr + 1, conv.fast))
    )
    before, now = F.lag("dist").over(by_segment()), F.col("dist")
    before_r = F.lag("dist_r").over(by_segment())
    enough = F.col("pos") >= conv.slow + 1
    crossed = F.when((before <= 0) & (now > 0), "UP").when((before >= 0) & (now < 0), "DOWN").otherwise("NONE")
    reason = (
        F.when(~_complete(), INCOMPLETE_INPUT)
        .when(~enough, INSUFFICIENT_HISTORY)
        .when(now.isNull() | before.isNull(), F.coalesce("dist_r", before_r, F.lit(INSUFFICIENT_HISTORY)))
    )
    return bars.withColumns(means).withColumns(ratios).withColumns({"cross_r": reason, "cross": F.when(reason.isNull(), crossed)})


def volumes(bars: DataFrame, conv: Conventions = Conventions()) -> DataFrame:
    """Median volume of the bars before, and this bar's volume over it."""
    enough = F.col("pos") >= conv.volume + 1
    median = F.percentile("v", F.lit(0.5)).over(by_segment().rowsBetween(-conv.volume, -1))
    reason = F.coalesce("v_median_r", F.when(F.col("v_median") == 0, ZERO_DENOMINATOR))
    return bars.withColumns({"v_median": F.when(enough, median), "v_median_r": _reason(enough)}).withColumns(
        {"v_ratio_r": reason, "v_ratio": F.when(reason.isNull(), F.col("v") / F.col("v_median"))}
    )


def pivots(bars: DataFrame, conv: Conventions = Conventions()) -> DataFrame:
    """Checks of the bar ``side`` places back, known at this one, and the pivot that it confirms, if any."""
    n, width = conv.side, 2 * conv.side + 1
    enough = F.col("pos") >= width
    back = lambda name, i: F.lag(name, i).over(by_segment()) if i else F.col(name)
    seen = {
        "check_r": _reason(enough),
        "candidate_t0": F.when(enough, back("t0", n)),
        "candidate_t1": F.when(enough, back("t1", n)),
        "__high": back("h", n),
        "__low": back("l", n),
    }
    for name, price, best in (("__highs", "h", F.greatest), ("__lows", "l", F.least)):
        seen[name] = best(*[back(price, i) for i in range(width) if i != n])

    def state(candidate: str, others: str, beyond: Column) -> Column:
        kind = F.when(beyond, "PIVOT").when(F.col(candidate) == F.col(others), "TIE").otherwise("NOT_EXTREME")
        return F.when(enough, kind)

    high = state("__high", "__highs", F.col("__high") > F.col("__highs"))
    low = state("__low", "__lows", F.col("__low") < F.col("__lows"))
    dual = F.coalesce((high == "PIVOT") & (low == "PIVOT"), F.lit(False))
    out = bars.withColumns(seen).withColumns({"__hs": high, "__ls": low, "dual": dual})
    is_high, is_low = ~F.col("dual") & (F.col("__hs") == "PIVOT"), ~F.col("dual") & (F.col("__ls") == "PIVOT")
    return out.withColumns(
        {
            "high_check": F.when(F.col("dual"), "DUAL_AMBIGUOUS").otherwise(F.col("__hs")),
            "low_check": F.when(F.col("dual"), "DUAL_AMBIGUOUS").otherwise(F.col("__ls")),
            "pivot_kind": F.when(is_high, "HIGH").when(is_low, "LOW"),
            "pivot_price": F.when(is_high, F.col("__high")).when(is_low, F.col("__low")),
        }
    ).drop("__high", "__low", "__highs", "__lows", "__hs", "__ls")


#: The memory of a series at a confirmed pivot: last pivots and last anchors of each kind, with the segment they belong to.
_MEMORY = ("high", "low", "high_anchor", "low_anchor", "version")


def sequence(observed: DataFrame, block_bars: int = scan.BLOCK_ROWS) -> DataFrame:
    """Confirmed pivots in order: what each does to the alternating sequence, and what is remembered from it on.

    A run of pivots of one kind is an island. A pivot APPENDs if it begins one, and REPLACEs the end of the sequence if it
    is beyond all of its kind since the last one of the other kind; else it is kept out (KEEP). All of it is running
    values over blocks of time: the last pivot of either kind before this one; then the greatest among those with the
    same predecessor of the other kind; then what all that comes to up to this pivot.
    """
    columns = (F.col("pivot_kind").alias("kind"), F.col("pivot_price").alias("price"), F.col("candidate_t0").alias("c0"), F.col("candidate_t1").alias("c1"))
    rows = _written(observed.filter("pivot_kind is not null").select("series", "segment", "t0", "t1", *columns))
    found = _marked(rows, block_bars)
    return _written(found.select("series", "segment", "t0", "t1", "kind", "price", "c0", "c1", F.col("__islands").alias("island"), "action", *_MEMORY))


def _written(rows: DataFrame) -> DataFrame:
    """Rows that several branches read, written unless they are few."""
    return rows if scan.few(rows) else materialize(rows)


def _marked(rows: DataFrame, block_bars: int) -> DataFrame:
    """Rows with kind, price, c0 and c1 of the pivot that they confirm, if any, with action, island and memory."""
    kind, block = F.col("kind"), scan.block_of("t0", block_bars * (F.col("t1") - F.col("t0")))
    scanned = lambda df, runs: scan.running(df, ["series"], ["t0"], block, runs)
    of = lambda name, value: F.when(kind == name, value)
    seen = F.struct("segment", "t0", "price")
    rows = scanned(rows, {"__high": scan.last(of("HIGH", seen), before=True), "__low": scan.last(of("LOW", seen), before=True)})
    is_high = kind == "HIGH"
    own, other = F.when(is_high, F.col("__high")).otherwise(F.col("__low")), F.when(is_high, F.col("__low")).otherwise(F.col("__high"))
    here = lambda x: F.when(x["segment"] == F.col("segment"), x)  # noqa: E731  of this segment only
    rows = rows.withColumns({"__own": here(own), "__other": F.coalesce(here(other)["t0"], F.lit(-1))})
    turned = kind.isNotNull() & ~F.coalesce(F.col("__own.t0") > F.col("__other"), F.lit(False))
    signed = F.when(is_high, F.col("price")).otherwise(-F.col("price"))
    rows = rows.withColumns({"__turned": turned, "__best": F.struct("segment", F.col("__other").alias("other"), signed.alias("price"))})
    best = {"__highest": scan.greatest(of("HIGH", F.col("__best")), before=True), "__lowest": scan.greatest(of("LOW", F.col("__best")), before=True)}
    rows = scanned(_written(rows), best | {"__islands": scan.total(F.col("__turned").cast("long"))})
    beaten = signed > F.when(is_high, F.col("__highest")).otherwise(F.col("__lowest"))["price"]  # of the island, where none begins
    action = F.when(F.col("__turned"), "APPEND").when(beaten, "REPLACE").when(kind.isNotNull(), "KEEP")
    rows = rows.withColumn("action", action)
    kept = F.coalesce(F.col("action") != "KEEP", F.lit(False))
    pivot = F.struct("segment", "price", F.col("__own.price").alias("before"), "c0", F.col("t1").alias("known"))
    anchor = F.when(kept, F.struct("segment", "kind", "price", "c0", "c1", F.col("t1").alias("known")))
    runs = {
        "high": scan.last(of("HIGH", pivot)),
        "low": scan.last(of("LOW", pivot)),
        "high_anchor": scan.last(of("HIGH", anchor)),
        "low_anchor": scan.last(of("LOW", anchor)),
        "version": scan.total(kept.cast("long")),
    }
    return scanned(rows, runs)


def _here(memory: Column) -> Column:
    """What is remembered, if it is of this bar's segment."""
    return F.when(memory["segment"] == F.col("segment"), memory)


def _anchors(row: DataFrame) -> DataFrame:
    """``p1``: the later of the two last anchors of the segment; ``p0``: the other one."""
    high, low = _here(F.col("high_anchor")), _here(F.col("low_anchor"))
    bare = lambda x: F.when(x.isNotNull(), F.struct(*[x[n].alias(n) for n in ("kind", "price", "c0", "c1", "known")]))
    later = F.coalesce(high["known"], F.lit(-1)) > F.coalesce(low["known"], F.lit(-1))
    return row.withColumns({"p1": F.when(later, bare(high)).otherwise(bare(low)), "p0": F.when(later, bare(low)).otherwise(bare(high))})


def remembered(observed: DataFrame, block_bars: int = scan.BLOCK_ROWS) -> DataFrame:
    """``observed`` with the memory of the last row of ``sequence`` at or before each bar."""
    if scan.few(observed):
        names = {"kind": "pivot_kind", "price": "pivot_price", "c0": "candidate_t0", "c1": "candidate_t1"}
        return _marked(observed.withColumns({n: F.col(c) for n, c in names.items()}), block_bars).select(*observed.columns, *_MEMORY)
    state = sequence(observed, block_bars).select("series", "t0", "t1", *_MEMORY)
    found = asof.asof_join(observed, state, ["series"], "t0", "t0", "__", block_bars * (F.col("t1") - F.col("t0")))
    return found.drop("__t0", "__t1").withColumnsRenamed({f"__{c}": c for c in _MEMORY})


def structure(observed: DataFrame, block_bars: int = scan.BLOCK_ROWS) -> DataFrame:
    """UP, DOWN or MIXED by the last two confirmed highs and lows of the segment."""
    return _structured(remembered(observed, block_bars)).drop(*_MEMORY)


def _structured(out: DataFrame) -> DataFrame:
    last = {}
    for name in ("high", "low"):
        seen = _here(F.col(name))
        last |= {f"{name}_last": seen["price"], f"{name}_before": seen["before"], f"{name}_t0": seen["c0"], f"{name}_t1": seen["known"]}
    out = out.withColumns(last)
    known = F.col("high_before").isNotNull() & F.col("low_before").isNotNull()
    up = (F.col("high_last") > F.col("high_before")) & (F.col("low_last") > F.col("low_before"))
    down = (F.col("high_last") < F.col("high_before")) & (F.col("low_last") < F.col("low_before"))
    state = F.when(up, "UP").when(down, "DOWN").otherwise("MIXED")
    reason = F.when(~_complete(), INCOMPLETE_INPUT).when(~known, NO_CONFIRMED_PIVOTS)
    return out.withColumns({"structure": F.when(_complete() & known, state), "structure_r": reason})


def alternation(observed: DataFrame, block_bars: int = scan.BLOCK_ROWS) -> DataFrame:
    """The alternating sequence of confirmed pivots: APPEND, REPLACE or KEEP, its version and its two anchors."""
    return _anchors(sequence(observed, block_bars)).select("series", "segment", "t0", "t1", "kind", "price", "c0", "c1", "island", "action", "p1", "p0", "version")


def _anchored(out: DataFrame) -> DataFrame:
    """Anchors known at each bar, with u and r: how far the close has gone from the first to the second."""
    out = _anchors(out).withColumn("version", F.coalesce("version", F.lit(0)))
    p0 = F.when(_complete(), F.col("p0"))
    out = out.withColumns({"p0": p0, "p1": F.when(p0.isNotNull(), F.col("p1"))})
    span = F.col("p1.price") - F.col("p0.price")
    reason = F.when(~_complete(), INCOMPLETE_INPUT).when(F.col("p0").isNull(), NO_CONFIRMED_PIVOTS).when(span == 0, ANCHORS_EQUAL)
    u = F.when(reason.isNull(), (F.col("c") - F.col("p0.price")) / span)
    return out.withColumns({"anchors_r": reason, "u": u, "r": 1 - u})


def geometry(observed: DataFrame, conv: Conventions = Conventions()) -> DataFrame:
    """One row for each bar with anchors and ratio: the price of a retracement or projection and its distance."""
    p0, p1 = F.col("p0.price"), F.col("p1.price")
    made = lambda kind, ratios, price: F.transform(
        F.array(*[F.lit(x) for x in ratios]),
        lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ratio"), price(x).alias("price")),
    )
    both = F.concat(
        made("RETRACEMENT", conv.retracements, lambda x: p1 - x * (p1 - p0)),
        made("PROJECTION", conv.projections, lambda x: p0 + x * (p1 - p0)),
    )
    rows = observed.filter("anchors_r is null").select("series", "t1", "version", "c", "a", "a_r", F.explode(both).alias("g"))
    price = F.col("g.price")
    return rows.select(
        "series",
        "t1",
        "version",
        F.col("g.kind").alias("kind"),
        F.col("g.ratio").alias("ratio"),
        price.alias("price"),
        F.when(F.col("a") != 0, (F.col("c") - price) / F.col("a")).alias("dist"),
    )


def levels(observed: DataFrame, daily: DataFrame) -> DataFrame:
    """Levels known at each bar: last pivot high and low, and high and low of the last day that ended.

    The day is an equi-join on its end; it is the day [floor(t1) - 1, floor(t1)).
    """
    days = daily.select("series", F.col("t1").alias("day_end"), F.col("h").alias("day_high"), F.col("l").alias("day_low"), F.col("status").alias("day_status"))
    out = observed.withColumn("day_end", floor_day(F.col("t1"))).join(days, ["series", "day_end"], "left")
    return out.withColumn(
        "day_r",
        F.when(F.col("day_status").isNull(), INSUFFICIENT_HISTORY).when(F.col("day_status") != COMPLETE, INCOMPLETE_INPUT),
    )


LEVELS = (("PIVOT_HIGH", "high_last"), ("PIVOT_LOW", "low_last"), ("DAY_HIGH", "day_high"), ("DAY_LOW", "day_low"))


def crossings(leveled: DataFrame) -> DataFrame:
    """Closes that crossed a level which was known at the bar before."""
    known = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.lag(F.when(_complete(), F.col(price))).over(by_segment()).alias("price"))
            for kind, price in LEVELS
        ]
    )
    rows = leveled.withColumn("__c", F.lag("c").over(by_segment())).withColumn("__l", known)
    rows = rows.filter(_complete() & F.col("__c").isNotNull()).select(
        "series", "segment", "t0", "t1", "a", "a_r", "c", F.col("__c").alias("previous"), F.explode("__l").alias("level")
    )
    price = F.col("level.price")
    up, down = (F.col("previous") <= price) & (price < F.col("c")), (F.col("previous") >= price) & (price > F.col("c"))
    return (
        rows.withColumn("direction", F.when(up, "UP").when(down, "DOWN"))
        .filter("direction is not null")
        .select("series", "t1", F.col("level.kind").alias("kind"), price.alias("price"), "direction", "previous", "c")
    )


def observe(bars: DataFrame, conv: Conventions = Conventions(), block_bars: int = scan.BLOCK_ROWS) -> DataFrame:
    """All measures of each bar; ``bars`` come from ``bars.aggregate``."""
    out = volatility(segments(bars, block_bars), conv)
    out = remembered(_written(pivots(volumes(averages(out, conv), conv), conv)), block_bars)
    return _anchored(_structured(out)).drop("high", "low", "high_anchor", "low_anchor")


def events(observed: DataFrame, sequence: DataFrame, crossed: DataFrame) -> DataFrame:
    """What became known when, as one log: type, time of the event and time from which it is available."""
    def log(df: DataFrame, kind: str, at: Column, known: Column, key: Column, price: Column) -> DataFrame:
        return df.select(
            "series",
            F.lit(kind).alias("type"),
            at.alias("event_at"),
            known.alias("known_at"),
            key.cast("string").alias("key"),
            price.cast("double").alias("price"),
        )

    t1, cand = F.col("t1"), F.col("candidate_t1")
    bare = observed.select("series", "t0", "t1", "status")
    ended = with_previous(bare, {"__was": "status"}).filter((F.col("status") != COMPLETE) & (F.col("__was") == COMPLETE))
    ties = observed.select("*", F.explode(F.array(F.lit("HIGH"), F.lit("LOW"))).alias("tied")).filter(
        ((F.col("tied") == "HIGH") & (F.col("high_check") == "TIE")) | ((F.col("tied") == "LOW") & (F.col("low_check") == "TIE"))
    )
    none = F.lit(None)
    parts = [
        log(observed.filter("pivot_kind is not null"), "PIVOT_CONFIRMED", cand, t1, F.col("pivot_kind"), F.col("pivot_price")),
        log(ties, "PIVOT_REJECTED", cand, t1, F.col("tied"), none),
        log(observed.filter("dual"), "PIVOT_DUAL_AMBIGUOUS", cand, t1, F.lit("DUAL"), none),
        log(sequence, "SEQUENCE", F.col("c1"), t1, F.concat_ws(":", "action", "kind"), F.col("price")),
        log(observed.filter("cross in ('UP', 'DOWN')"), "AVERAGE_CROSS", t1, t1, F.col("cross"), none),
        log(crossed, "LEVEL_CROSS", t1, t1, F.concat_ws(":", "kind", "direction"), F.col("price")),
        log(ended, "SEGMENT_RESET", t1, t1, F.lit(INCOMPLETE_INPUT), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def availability(observed: DataFrame, names: list[str]) -> DataFrame:
    """Long form: for each measure of each bar, whether it is there, or its reason."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"{n}_r").alias("reason")) for n in names])).alias("m")
    return observed.select("series", "t1", pairs).select("series", "t1", "m.measure", "m.reason")
