"""Ordered folds over events: average-cost accounts and the state of a simulated order book.

Each key's events are few, sorted in an array and folded in the JVM by ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 9


def clean(value: Column) -> Column:
    """Without the noise of binary fractions."""
    return F.round(value, PLACES)


def average_cost(fills: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Account of each key after its fills (side BUY or SELL, qty, price, fee) in order.

    Fills on the side of the position average its price; fills against it realise a result at that average, up to the
    quantity that is open. A fill that is larger turns the position: the rest opens a new one at its own price.
    """
    item = F.struct(*order, "side", "qty", "price", "fee")
    rows = fills.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("fills"))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("qty"), zero.alias("avg"), zero.alias("realized"), zero.alias("fees"), F.lit(0).alias("closes"))

    def step(s: Column, f: Column) -> Column:
        signed = F.when(f["side"] == "BUY", f["qty"]).otherwise(-f["qty"])
        same = (s["qty"] == 0) | (F.signum(s["qty"]) == F.signum(signed))
        after = clean(s["qty"] + signed)
        closed = F.least(f["qty"], F.abs(s["qty"]))
        blended = clean((F.abs(s["qty"]) * s["avg"] + f["qty"] * f["price"]) / F.abs(after))
        turned = ~same & (f["qty"] > F.abs(s["qty"]))
        avg = F.when(after == 0, zero).when(same, blended).when(turned, f["price"]).otherwise(s["avg"])
        gain = clean(closed * (f["price"] - s["avg"]) * F.signum(s["qty"]))
        return F.struct(
            after.alias("qty"),
            avg.alias("avg"),
            F.when(same, s["realized"]).otherwise(clean(s["realized"] + gain)).alias("realized"),
            clean(s["fees"] + f["fee"]).alias("fees"),
            (s["closes"] + (~same).cast("int")).alias("closes"),
        )

    folded = rows.select(*by, F.aggregate("fills", start, step).alias("s"))
    return folded.select(*by, "s.qty", F.col("s.avg").alias("avg_price"), "s.realized", "s.fees", (F.col("s.realized") - F.col("s.fees")).alias("net"), "s.closes")


def equity(accounts: DataFrame, marks: DataFrame, by: list[str], initial: float) -> DataFrame:
    """Balance and equity; equity is unknown while a position has no current mark, the last one is kept apart."""
    met = accounts.join(marks, by, "left")
    balance = initial + F.col("net")
    open_result = F.when(F.col("qty") == 0, 0.0).otherwise(clean(F.col("qty") * (F.col("mark") - F.col("avg_price"))))
    known = (F.col("qty") == 0) | F.coalesce("current", F.lit(False))
    return met.select(
        *by, clean(balance).alias("balance"), F.when(known, clean(balance + open_result)).alias("equity"), clean(balance + open_result).alias("last_known_equity")
    )


def order_book(events: DataFrame, by: list[str]) -> DataFrame:
    """State after events (at, seq, kind, order_id, side, qty, price): open orders, position, stop and mode.

    ORDER opens one, CANCEL and FILL end it if it is open (others are ignored), STOP moves the protection of an open
    position, MODE switches execution. A position that is closed cancels its protection.
    """
    item = F.struct("at", "seq", "kind", "order_id", "side", "qty", "price")
    rows = events.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("events"))
    start = F.struct(
        F.array().cast("array<struct<id:string,side:string,qty:double>>").alias("orders"),
        F.lit(0.0).alias("position"),
        F.lit(None).cast("double").alias("stop"),
        F.lit("EXECUTE").alias("mode"),
        F.lit(0).alias("ignored"),
        F.lit(0).alias("fills"),
    )

    def step(s: Column, e: Column) -> Column:
        kind = e["kind"]
        hit = F.filter(s["orders"], lambda o: o["id"] == e["order_id"])
        rest = F.filter(s["orders"], lambda o: o["id"] != e["order_id"])
        found = F.size(hit) > 0
        order = F.get(hit, 0)
        fills = (kind == "FILL") & found
        move = F.when(order["side"] == "BUY", order["qty"]).otherwise(-order["qty"])
        position = F.when(fills, clean(s["position"] + move)).otherwise(s["position"])
        opened = F.concat(rest, F.array(F.struct(e["order_id"].alias("id"), e["side"].alias("side"), e["qty"].alias("qty"))))
        stop = F.when(position == 0, F.lit(None)).when(kind == "STOP", e["price"]).otherwise(s["stop"])
        useless = (kind.isin("FILL", "CANCEL") & ~found) | ((kind == "STOP") & (position == 0))
        return F.struct(
            F.when(kind == "ORDER", opened).when(fills | (kind == "CANCEL"), rest).otherwise(s["orders"]).alias("orders"),
            position.alias("position"),
            stop.alias("stop"),
            F.when(kind == "MODE", e["side"]).otherwise(s["mode"]).alias("mode"),
            (s["ignored"] + useless.cast("int")).alias("ignored"),
            (s["fills"] + fills.cast("int")).alias("fills"),
        )

    folded = rows.select(*by, F.aggregate("events", start, step).alias("s"))
    return folded.select(*by, F.size("s.orders").alias("open_orders"), "s.position", "s.stop", "s.mode", "s.ignored", "s.fills")
