"""Bars and their state from a stream of ticks.

A watermark says how late a tick may be. A bar is emitted once, when the watermark has passed its end, so what is
emitted never changes; ticks that come later than that are dropped by Spark and counted by ``late_ticks``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.bars import COMPLETE, INCOMPLETE


def late_ticks(query: StreamingQuery) -> int:
    """Ticks that came behind the watermark and were dropped, over the batches whose progress the query still has."""
    operators = [o for p in query.recentProgress for o in json.loads(p.json)["stateOperators"]]
    return sum(o.get("numRowsDroppedByWatermark", 0) for o in operators)


def stream_bars(ticks: DataFrame, width: str, late: str, min_ticks: int = 1) -> DataFrame:
    """Tumbling bars of streaming ticks (series, ts TIMESTAMP, price, qty), in append mode."""
    window = F.window("ts", width).alias("w")
    found = ticks.withWatermark("ts", late).groupBy("series", window).agg(
        F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "ts").alias("c"),
        F.sum("qty").alias("v"), F.count(F.lit(1)).alias("ticks"),
    )
    return found.select(
        "series", F.col("w.start").alias("t0"), F.col("w.end").alias("t1"),
        F.when(F.col("ticks") >= min_ticks, COMPLETE).otherwise(INCOMPLETE).alias("status"), "ticks", "o", "h", "l", "c", "v",
    )


def running_range(bars: DataFrame, window: int) -> DataFrame:
    """Mean true range over the last bars of each series, from a stream of its bars in time order.

    State is the last close and the last ``window`` ranges of a series. A bar that does not follow the one before
    starts again.
    """
    out = "series string, t1 timestamp, tr double, a double"
    state = "t1 timestamp, c double, ranges array<double>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, close, ranges = held.get if held.exists else (None, None, [])
        ranges, rows = list(ranges or []), []
        for b in pd.concat(list(batches)).sort_values("t1").itertuples():
            if last is None or b.t0 != last or b.status != COMPLETE:
                close, ranges = None, []
            tr = None if close is None else max(b.h - b.l, abs(b.h - close), abs(b.l - close))
            if tr is not None:
                ranges = [*ranges, tr][-window:]
            rows.append((key[0], b.t1, tr, sum(ranges) / window if len(ranges) == window else None))
            last, close = b.t1, b.c if b.status == COMPLETE else None
        held.update((last, close, ranges))
        yield pd.DataFrame(rows, columns=["series", "t1", "tr", "a"])

    return bars.groupBy("series").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)
