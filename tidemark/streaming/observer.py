"""The observations of bars as a live stream of ticks makes them: one row for each bar of each series, as soon as it is over.

Every series has a typed state: the bars that are still open, and what looking back needs of the closed ones (segment,
last closes, ranges and volumes, the bars around a pivot, last two highs and lows, the alternating sequence with its
version). A timer stands at the end of the next bar. When the watermark passes it the bar is closed with what it has,
also with nothing, so gaps are rows here as they are in ``observe.observe``; the rows are the same whatever the order of
arrival within the lateness, and after a restart from the checkpoint.

Ticks behind the last closed bar are not taken in any more; ``late_ticks`` counts those that Spark drops. Ticks without
a time or price are passed over. A series begins with the day of its first tick and goes on as long as the stream does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields
from statistics import median

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.measures import ANCHORS_EQUAL, INCOMPLETE_INPUT, INSUFFICIENT_HISTORY, NO_CONFIRMED_PIVOTS, ZERO_DENOMINATOR
from tidemark.functions.scalars import DAY
from tidemark.operators.bars import COMPLETE, INCOMPLETE
from tidemark.operators.observe import Conventions

_ANCHOR = ("kind string", "price double", "c0 bigint", "c1 bigint", "known bigint")
#: Columns of a row; the anchors of ``observe.observe`` are spread (``spread``).
OUTPUT = ", ".join(
    [
        "series string, t0 bigint, t1 bigint, status string, ticks bigint, o double, h double, l double, c double, v double, segment bigint, pos bigint",
        "tr double, tr_r string, a double, a_r string, a_over_c double, sma_fast double, sma_fast_r string, sma_slow double, sma_slow_r string",
        "dist double, dist_r string, slope double, slope_r string, place double, place_r string, `cross` string, cross_r string",
        "v_median double, v_median_r string, v_ratio double, v_ratio_r string, check_r string, candidate_t0 bigint, candidate_t1 bigint",
        "high_check string, low_check string, dual boolean, pivot_kind string, pivot_price double",
        "high_last double, high_before double, low_last double, low_before double, structure string, structure_r string, version bigint",
        *[f"{p}_{x}" for p in ("p0", "p1") for x in _ANCHOR],
        "anchors_r string, u double, r double",
    ]
)
_OPEN = "o double, o_at bigint, h double, l double, c double, c_at bigint, v double, ticks bigint"
_TYPES = {"int": "bigint", "float": "double", "str": "string", "list[float]": "array<double>", "list[int]": "array<bigint>"}

Anchor = tuple[str, float, int, int, int]


@dataclass
class Walk:
    """What is kept of a series; ``close`` takes the next bar and returns its observation. No anchor has an empty kind."""

    next_t0: int = 0
    segment: int = 0
    pos: int = 0
    version: int = 0
    closes: list[float] = field(default_factory=list)
    fasts: list[float] = field(default_factory=list)
    ranges: list[float] = field(default_factory=list)
    volumes: list[float] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    highs: list[float] = field(default_factory=list)
    lows: list[float] = field(default_factory=list)
    dist: list[float] = field(default_factory=list)
    dist_r: str = ""
    last_highs: list[float] = field(default_factory=list)
    last_lows: list[float] = field(default_factory=list)
    p0_kind: str = ""
    p0_price: float = 0.0
    p0_times: list[int] = field(default_factory=list)
    p1_kind: str = ""
    p1_price: float = 0.0
    p1_times: list[int] = field(default_factory=list)

    def _reset(self) -> None:
        """A gap: all but the count of segments and the version starts again."""
        kept = (self.next_t0, self.segment, self.version)
        for name, value in asdict(Walk()).items():
            setattr(self, name, value)
        self.next_t0, self.segment, self.version = kept

    def _pivot(self, width: int, conv: Conventions) -> dict:
        """The check of the bar ``side`` places back."""
        side = conv.side
        wide = 2 * side + 1
        self.starts, self.highs, self.lows = self.starts[-wide:], self.highs[-wide:], self.lows[-wide:]
        if self.pos < wide:
            return {"check_r": INSUFFICIENT_HISTORY, "dual": False}
        state = lambda own, other, beyond: "PIVOT" if beyond else "TIE" if own == other else "NOT_EXTREME"
        high, low = self.highs[side], self.lows[side]
        top, bottom = max(self.highs[:side] + self.highs[side + 1 :]), min(self.lows[:side] + self.lows[side + 1 :])
        hs, ls = state(high, top, high > top), state(low, bottom, low < bottom)
        start = self.starts[side]
        seen = {"candidate_t0": start, "candidate_t1": start + width, "dual": hs == ls == "PIVOT"}
        if seen["dual"]:
            return seen | {"high_check": "DUAL_AMBIGUOUS", "low_check": "DUAL_AMBIGUOUS"}
        kind, price = ("HIGH", high) if hs == "PIVOT" else ("LOW", low) if ls == "PIVOT" else (None, None)
        return seen | {"high_check": hs, "low_check": ls, "pivot_kind": kind, "pivot_price": price}

    def _turn(self, seen: dict, t1: int) -> None:
        """A confirmed pivot appends to the alternating sequence, replaces its end, or is kept out."""
        kind, price = seen["pivot_kind"], seen["pivot_price"]
        times = [seen["candidate_t0"], seen["candidate_t1"], t1]
        (self.last_highs if kind == "HIGH" else self.last_lows).append(price)
        self.last_highs, self.last_lows = self.last_highs[-2:], self.last_lows[-2:]
        if kind != self.p1_kind:
            self.p0_kind, self.p0_price, self.p0_times = self.p1_kind, self.p1_price, self.p1_times
        elif not (price > self.p1_price if kind == "HIGH" else price < self.p1_price):
            return
        self.p1_kind, self.p1_price, self.p1_times = kind, price, times
        self.version += 1

    def close(self, bar: tuple | None, width: int, conv: Conventions) -> dict:
        """``bar``: open, high, low, close, volume and ticks of the bar at ``next_t0`` if it is complete."""
        t0, t1 = self.next_t0, self.next_t0 + width
        self.next_t0 = t1
        row = {"t0": t0, "t1": t1, "version": self.version, "dual": False}
        if bar is None:
            self._reset()
            missing = ("tr", "a", "sma_fast", "sma_slow", "dist", "slope", "place", "cross", "v_median", "v_ratio", "check", "structure", "anchors")
            return row | {"status": INCOMPLETE} | {f"{x}_r": INCOMPLETE_INPUT for x in missing}
        o, h, l, c, v, ticks = bar  # noqa: E741
        before = self.closes[-1] if self.closes else None
        self.segment += not self.pos
        self.pos += 1
        pos, short = self.pos, lambda n: INSUFFICIENT_HISTORY if pos < n else None
        row |= {"status": COMPLETE, "ticks": ticks, "o": o, "h": h, "l": l, "c": c, "v": v, "segment": self.segment, "pos": pos}
        if before is not None:
            row["tr"] = max(h - l, abs(h - before), abs(l - before))
            self.ranges = [*self.ranges, row["tr"]][-conv.tr :]
        row |= {"tr_r": short(2), "a_r": short(conv.tr + 1)}
        a = None if row["a_r"] else sum(self.ranges) / conv.tr
        self.closes = [*self.closes, c][-max(conv.fast, conv.slow) :]
        mean = lambda n: None if pos < n else sum(self.closes[-n:]) / n
        fast, slow = mean(conv.fast), mean(conv.slow)
        row |= {"a": a, "a_over_c": a / c if a is not None and c else None, "sma_fast": fast, "sma_fast_r": short(conv.fast), "sma_slow": slow, "sma_slow_r": short(conv.slow)}

        def over_a(name: str, n: int, numerator: Callable[[], float]) -> None:
            reason = short(n) or (row["a_r"] if a is None else ZERO_DENOMINATOR if a == 0 else None)
            row.update({f"{name}_r": reason, name: None if reason else numerator() / a})

        over_a("dist", conv.slow, lambda: fast - slow)
        over_a("slope", conv.fast + conv.lag, lambda: fast - self.fasts[-conv.lag])
        over_a("place", max(conv.tr + 1, conv.fast), lambda: c - fast)
        if fast is not None:
            self.fasts = [*self.fasts, fast][-conv.lag :]
        now, was = row["dist"], self.dist[0] if self.dist else None
        row["cross_r"] = short(conv.slow + 1) or ((row["dist_r"] or self.dist_r or INSUFFICIENT_HISTORY) if now is None or was is None else None)
        if row["cross_r"] is None:
            row["cross"] = "UP" if was <= 0 < now else "DOWN" if was >= 0 > now else "NONE"
        self.dist, self.dist_r = [] if now is None else [now], row["dist_r"] or ""
        row["v_median_r"] = short(conv.volume + 1)
        if row["v_median_r"] is None:
            row["v_median"] = median(self.volumes)
        row["v_ratio_r"] = row["v_median_r"] or (ZERO_DENOMINATOR if row["v_median"] == 0 else None)
        row["v_ratio"] = None if row["v_ratio_r"] else v / row["v_median"]
        self.volumes = [*self.volumes, v][-conv.volume :]
        self.starts, self.highs, self.lows = [*self.starts, t0], [*self.highs, h], [*self.lows, l]
        seen = self._pivot(width, conv)
        if seen.get("pivot_kind"):
            self._turn(seen, t1)
        return row | seen | {"version": self.version} | self._state(c)

    def _state(self, c: float) -> dict:
        """Structure and anchors as they are known now."""
        out: dict = {}
        for name, last in (("high", self.last_highs), ("low", self.last_lows)):
            out |= {f"{name}_last": last[-1] if last else None, f"{name}_before": last[0] if len(last) == 2 else None}
        if out["high_before"] is None or out["low_before"] is None:
            out["structure_r"] = NO_CONFIRMED_PIVOTS
        else:
            up = out["high_last"] > out["high_before"] and out["low_last"] > out["low_before"]
            down = out["high_last"] < out["high_before"] and out["low_last"] < out["low_before"]
            out["structure"] = "UP" if up else "DOWN" if down else "MIXED"
        if not self.p0_kind:
            return out | {"anchors_r": NO_CONFIRMED_PIVOTS}
        for name, kind, price, times in (("p0", self.p0_kind, self.p0_price, self.p0_times), ("p1", self.p1_kind, self.p1_price, self.p1_times)):
            out |= {f"{name}_{x}": y for x, y in zip(("kind", "price", "c0", "c1", "known"), (kind, price, *times), strict=True)}
        span = self.p1_price - self.p0_price
        if span == 0:
            return out | {"anchors_r": ANCHORS_EQUAL}
        u = (c - self.p0_price) / span
        return out | {"u": u, "r": 1 - u}


_WALK = ", ".join(f"{f.name} {_TYPES[f.type]}" for f in fields(Walk))
_NAMES = [x.split()[0].strip("`") for x in OUTPUT.split(", ")]
_ROW = Row(*_NAMES)


class Observer(StatefulProcessor):
    """Ticks of a series to observations; ``width`` and ``min_ticks`` as in ``bars.aggregate``."""

    def __init__(self, width: int, min_ticks: int = 1, conv: Conventions = Conventions()) -> None:
        self.width, self.min_ticks, self.conv = width, min_ticks, conv

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.walk = handle.getValueState("walk", _WALK)
        self.open = handle.getMapState("open", "t0 bigint", _OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found: dict[int, tuple] = {}
        began = self.walk.get()[0] if self.walk.exists() else None
        for x in rows:
            if x.t is None or x.price is None:
                continue
            t0 = x.t - x.t % self.width
            if began is not None and t0 < began:
                continue  # its bar is closed
            bar, qty = found.get(t0), x.qty or 0.0
            if bar is None and self.open.containsKey((t0,)):
                bar = tuple(self.open.getValue((t0,)))
            if bar is None:
                found[t0] = (x.price, x.at, x.price, x.price, x.price, x.at, qty, 1)
                continue
            o, o_at, h, l, c, c_at, v, n = bar  # noqa: E741
            o, o_at = (x.price, x.at) if x.at < o_at else (o, o_at)
            c, c_at = (x.price, x.at) if x.at > c_at else (c, c_at)
            found[t0] = (o, o_at, max(h, x.price), min(l, x.price), c, c_at, v + qty, n + 1)
        for t0, bar in found.items():
            self.open.updateValue((t0,), bar)
            if began is None:
                self.handle.registerTimer(t0 + self.width)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        if self.walk.exists():
            kept = self.walk.get()
            walk = Walk(*(list(x) if isinstance(x, list | tuple) else x for x in kept))
        else:
            first = min((k[0] for k in self.open.keys()), default=None)
            if first is None:
                return
            walk = Walk(next_t0=first - first % DAY)
        if walk.next_t0 + self.width > until:
            return
        while walk.next_t0 + self.width <= until:
            t0, bar = walk.next_t0, None
            if self.open.containsKey((t0,)):
                bar = self.open.getValue((t0,))
                self.open.removeKey((t0,))
            ticks = bar[7] if bar else 0
            made = walk.close((bar[0], bar[2], bar[3], bar[4], bar[6], ticks) if ticks >= max(1, self.min_ticks) else None, self.width, self.conv)
            made |= {"series": key[0], "ticks": ticks}
            yield _ROW(*[made.get(n) for n in _NAMES])
        self.walk.update(tuple(getattr(walk, f.name) for f in fields(Walk)))
        self.handle.registerTimer(walk.next_t0 + self.width)

    def close(self) -> None:
        pass


def observe_stream(ticks: DataFrame, width: int, late: str, min_ticks: int = 1, conv: Conventions = Conventions()) -> DataFrame:
    """Observations (``OUTPUT``) of streaming ticks (series, ts TIMESTAMP, t, at, price, qty), in append mode.

    ``t`` is the time in milliseconds, ``at`` a whole number that orders ticks; ``late`` is how late a tick may be.
    The query must run with the state store of ``state_store``.
    """
    rows = ticks.withWatermark("ts", late).select("series", "ts", "t", F.col("at").cast("bigint").alias("at"), "price", "qty")
    made = rows.groupBy("series").transformWithState(Observer(width, min_ticks, conv), OUTPUT, "append", "eventTime")
    return made


def spread(observed: DataFrame) -> DataFrame:
    """Rows of ``observe.observe`` with the anchors' fields as columns, like those of the stream."""
    flat: list[Column] = [F.col(f"{p}.{x.split()[0]}").alias(f"{p}_{x.split()[0]}") for p in ("p0", "p1") for x in _ANCHOR]
    return observed.select("*", *flat).select(*_NAMES)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which typed state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
