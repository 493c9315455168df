"""Decisions, ledger, lifecycle and replay."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_observe import BAR, frame, walk
from tidemark.operators import decisions, ledger, lifecycle, observe, replay

RULES = decisions.Rules(amplitude=0.5, reward_risk=0.2, depth_max=1.2)


def run(spark, rows):
    seen = observe.observe(frame(spark, rows))
    found = decisions.decisions(decisions.legs(observe.alternation(seen), seen, RULES), seen, RULES)
    return seen, found


def test_calls_are_filled_and_closed_by_the_bars(spark):
    rows = walk(600, 21, gaps={300})
    seen, found = run(spark, rows)
    entered = ledger.entries(found, seen, RULES)
    done = ledger.trades(entered, seen, RULES).collect()
    assert len(done) > 5
    for t in done:
        k = t.entry_at // BAR
        assert t.entry == pytest.approx(rows[k][0] * (1 + t.d * RULES.slippage))
        first = None
        for j in range(k, k + RULES.holding + 1):  # nothing may end the trade earlier at its first stop
            if j >= len(rows) or rows[j] is None:
                first = "gap"
                break
            o, h, low, _, _ = rows[j]
            at = j * BAR
            if t.exit_at is not None and (at > t.exit_at or (at == t.exit_at and j > k)):
                break
            worst, best = (low, h) if t.d == 1 else (h, low)
            if t.exit_at != (j + 1) * BAR and t.exit_at != at:
                assert t.d * (worst - t.stop0) > 0 and t.d * (best - t.target) < 0, (t, j)
        assert first != "gap" or t.reason in ("UNRESOLVED_DATA_GAP", None) or t.exit_at is not None
        if t.reason not in (None, "UNRESOLVED_DATA_GAP"):
            assert t.net == pytest.approx(t.price_pnl - t.fees) and t.stress_net < t.net
        else:
            assert t.net is None


def test_money_example(spark):
    row = [("S", "x", 1, 10.0, 100.0, 100.0, 1.0, 102.0, 102.0, False)]
    cols = "series string, leg_id string, d int, qty double, entry double, reference double, risk0 double, target double, exit_reference double, both boolean"
    rules = decisions.Rules(slippage=0.0)
    got = ledger.economics(spark.createDataFrame(row, cols), rules).withColumn("entry_at", F.lit(0)).withColumn("exit_at", F.lit(10 * 60_000))
    rates = spark.createDataFrame([("S", 5 * 60_000, 0.0001)], "series string, tau long, rate double")
    marks = spark.createDataFrame([("S", 4 * 60_000, 101.0)], "series string, mark_at long, mark double")
    paid = ledger.funding(got, rates, marks, 3_600_000).first()
    assert got.first().net + paid.funding == pytest.approx(18.889)
    unknown = ledger.funding(got, rates, marks.limit(0), 3_600_000).first()
    assert unknown.funding is None and unknown.funding_events == 1


def test_slot_is_taken_by_the_first_that_is_free(spark):
    rows = [("S", "a", 10, 20), ("S", "b", 15, 16), ("S", "c", 20, 21), ("S", "d", 21, None), ("S", "e", 99, 100), ("T", "f", 5, 6)]
    df = spark.createDataFrame(rows, "series string, leg_id string, at long, until long")
    got = {r.leg_id for r in decisions.one_slot(df, "at", "until", F.lit(True)).filter("slot = 'TAKEN'").collect()}
    assert got == {"a", "d", "f"}


@pytest.mark.parametrize("seed", [31, 32])
def test_lifecycle_holds_to_its_bars_and_its_past(spark, seed):
    rows = walk(700, seed, gaps={350})
    seen = observe.observe(frame(spark, rows))
    log = lifecycle.lifecycle(seen, observe.alternation(seen))
    assert lifecycle.violations(log, seen).count() == 0
    births = log.filter("type = 'BIRTH'").count()
    assert births > 3 and births == log.filter("type in ('ARCHIVE', 'OPEN_AT_END')").count()
    cut = 400
    other = observe.observe(frame(spark, rows[:cut] + walk(700, 99)[cut:]))
    again = lifecycle.lifecycle(other, observe.alternation(other))
    known = [sorted(map(str, x.filter(F.col("t") <= cut * BAR).collect())) for x in (log, again)]
    assert known[0] == known[1]
    turned = [r and (300 - r[0], 300 - r[2], 300 - r[1], 300 - r[3], r[4]) for r in rows]
    back = observe.observe(frame(spark, turned))
    flipped = lifecycle.lifecycle(back, observe.alternation(back))
    side = {"LONG": "SHORT", "SHORT": "LONG", None: None}
    a = sorted((r.t, r.seq, r.type, r.reason, str(r.side)) for r in log.collect())
    b = sorted((r.t, r.seq, r.type, r.reason, str(side[r.side])) for r in flipped.collect())
    assert a == b


def test_average_cost_matches_a_walk(spark):
    rnd, rows, wanted = random.Random(4), [], {}
    for key in range(20):
        qty = avg = gain = 0.0
        for at in range(rnd.randint(1, 30)):
            side, q, p = rnd.choice(["BUY", "SELL"]), float(rnd.randint(1, 5)), float(rnd.randint(90, 110))
            rows.append((key, at, side, q, p, 0.5))
            s = q if side == "BUY" else -q
            if qty == 0 or (qty > 0) == (s > 0):
                avg = (abs(qty) * avg + q * p) / (abs(qty) + q)
            else:
                gain += min(q, abs(qty)) * (p - avg) * (1 if qty > 0 else -1)
                avg = 0.0 if q == abs(qty) else p if q > abs(qty) else avg
            qty += s
        wanted[key] = (qty, avg, gain)
    got = replay.average_cost(spark.createDataFrame(rows, "k int, at int, side string, qty double, price double, fee double"), ["k"], ["at"])
    for r in got.collect():
        assert (r.qty, r.avg_price, r.realized) == pytest.approx(wanted[r.k], abs=1e-6)


def test_equity_is_unknown_under_a_stale_mark(spark):
    fills = spark.createDataFrame([("a", 1, "BUY", 2.0, 10.0, 1.0), ("b", 1, "BUY", 2.0, 10.0, 1.0)], "k string, at int, side string, qty double, price double, fee double")
    marks = spark.createDataFrame([("a", 12.0, True), ("b", 12.0, False)], "k string, mark double, current boolean")
    got = {r.k: r for r in replay.equity(replay.average_cost(fills, ["k"], ["at"]), marks, ["k"], 100.0).collect()}
    assert got["a"].equity == 103.0 and got["b"].equity is None and got["b"].last_known_equity == 103.0


def test_order_book_folds_events(spark):
    events = [("k", 1, 1, "ORDER", "1", "BUY", 2.0, None), ("k", 2, 1, "FILL", "1", None, None, 5.0), ("k", 3, 1, "STOP", None, None, None, 4.0), ("k", 4, 1, "FILL", "1", None, None, 5.0), ("k", 5, 1, "ORDER", "2", "SELL", 2.0, None), ("k", 6, 1, "FILL", "2", None, None, 6.0), ("k", 7, 1, "STOP", None, None, None, 3.0)]
    df = spark.createDataFrame(events, "k string, at int, seq int, kind string, order_id string, side string, qty double, price double")
    r = replay.order_book(df, ["k"]).first()
    assert (r.open_orders, r.position, r.stop, r.ignored, r.fills) == (0, 0.0, None, 2, 2)
