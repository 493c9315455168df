"""Worked examples, causality and mirror symmetry of observations."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import measures
from tidemark.operators import bars, observe, outcomes, population

BAR = 2_700_000
COLUMNS = "series string, t0 long, t1 long, status string, ticks long, o double, h double, l double, c double, v double"


def frame(spark, rows):
    """rows: (o, h, l, c, v) or None for a gap."""
    made = []
    for i, r in enumerate(rows):
        t0 = i * BAR
        made.append(("S", t0, t0 + BAR, "COMPLETE", 1, *map(float, r)) if r else ("S", t0, t0 + BAR, "INCOMPLETE", 0, None, None, None, None, None))
    return spark.createDataFrame(made, COLUMNS)


def walk(n, seed, gaps=()):
    rnd, c, out = random.Random(seed), 100.0, []
    for i in range(n):
        o = c
        c = max(1.0, c + rnd.choice([-2, -1, -0.5, 0, 0.5, 1, 2]))
        out.append(None if i in gaps else (o, max(o, c) + rnd.choice([0, 0.5, 1]), min(o, c) - rnd.choice([0, 0.5, 1]), c, float(rnd.randint(0, 9))))
    return out


def test_linear_bars_have_known_measures(spark):
    rows = [(100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, float(i)) for i in range(1, 52)]
    got = {r.pos: r for r in observe.observe(frame(spark, rows)).collect()}
    assert got[1].tr is None and got[1].tr_r == "INSUFFICIENT_HISTORY" and got[2].tr == 2
    assert got[20].a is None and got[21].a == 2
    assert got[20].sma_fast == 110.5 and got[50].sma_slow == 125.5 and got[50].dist == 7.5
    assert got[24].slope == 2 and got[21].place == 4.75
    assert got[21].v_median == 10.5 and got[21].v_ratio == 2
    assert got[50].cross is None and got[51].cross == "NONE"


def test_known_zero_is_not_missing(spark):
    got = {r.pos: r for r in observe.observe(frame(spark, [(5.0, 5.0, 5.0, 5.0, 0.0)] * 60)).collect()}
    assert got[30].a == 0 and got[30].a_over_c == 0 and got[50].dist is None and got[50].dist_r == "ZERO_DENOMINATOR"
    assert got[30].v_ratio_r == "ZERO_DENOMINATOR" and got[51].cross_r == "ZERO_DENOMINATOR"


def test_pivot_is_known_two_bars_later(spark):
    high, low = [10.0, 11, 15, 12, 11, 10], [5.0, 6, 7, 6, 5, 4]
    rows = [(x, h, x, x, 1.0) for h, x in zip(high, low, strict=True)]
    found = observe.pivots(bars.segments(frame(spark, rows))).filter("pivot_kind is not null").collect()
    assert [(r.pivot_kind, r.pivot_price, r.candidate_t0, r.t0) for r in found] == [("HIGH", 15.0, 2 * BAR, 4 * BAR)]


def test_ties_and_duals_are_no_pivots(spark):
    tie = [(1.0, h, 0.0, 1.0, 1.0) for h in (10.0, 15, 15, 12, 11)]
    assert observe.pivots(bars.segments(frame(spark, tie))).filter("high_check = 'TIE'").count() == 1
    dual = [(2.0, h, x, 2.0, 1.0) for h, x in ((10.0, 3.0), (10, 3), (15, 1), (10, 3), (10, 3))]
    row = observe.pivots(bars.segments(frame(spark, dual))).orderBy(F.desc("t0")).first()
    assert row.high_check == row.low_check == "DUAL_AMBIGUOUS" and row.pivot_kind is None


def test_gap_resets_segment_but_not_version(spark):
    got = observe.observe(frame(spark, walk(200, 3, gaps={90}))).orderBy("t0").collect()
    assert got[90].segment is None and got[90].a_r == "INCOMPLETE_INPUT"
    assert got[91].segment == got[89].segment + 1 and got[91].pos == 1 and got[91].a is None
    assert got[91].version == got[89].version > 0 and got[91].p0 is None


@pytest.mark.parametrize("cut", [60, 97, 140])
def test_what_is_known_does_not_change_with_the_future(spark, cut):
    rows = walk(180, 5, gaps={50, 120})
    other = rows[:cut] + walk(180, 77)[cut:]
    known = [observe.observe(frame(spark, r)).filter(F.col("t1") <= cut * BAR).orderBy("t0").collect() for r in (rows, other, rows[:cut])]
    assert known[0] == known[1] == known[2]
    logs = []
    for r in (rows, other):
        seen = observe.observe(frame(spark, r))
        crossed = observe.crossings(observe.levels(seen, bars.regroup(frame(spark, r), 86_400_000)))
        logs.append(sorted(map(str, observe.events(seen, observe.alternation(seen), crossed).filter(F.col("known_at") <= cut * BAR).collect())))
    assert logs[0] == logs[1]


def test_mirror_symmetry(spark):
    rows = walk(260, 9, gaps={70})
    turned = [r and (300 - r[0], 300 - r[2], 300 - r[1], 300 - r[3], r[4]) for r in rows]
    seen, back = (observe.observe(frame(spark, r)) for r in (rows, turned))
    flip = {"UP": "DOWN", "DOWN": "UP"}
    a = [(r.t0, r.structure, r.cross, r.version) for r in seen.orderBy("t0").collect()]
    b = [(r.t0, flip.get(r.structure, r.structure), flip.get(r.cross, r.cross), r.version) for r in back.orderBy("t0").collect()]
    assert a == b
    tries = [population.attempts(population.versions(observe.alternation(s), s), s) for s in (seen, back)]
    x, y = (sorted((r.t1, k * r.d, r.ordinal) for r in t.collect()) for t, k in zip(tries, (1, -1), strict=True))
    assert x == y and x


def plain_attempts(rows, versions, last):
    """Attempts by walking each group's closes."""
    found, previous = [], {}
    for k, b in enumerate(rows):
        if not b:
            continue
        for v in versions:
            i = v["p1_t0"] // BAR
            if not (v["active_from"] <= (k + 1) * BAR < v["retired_at"]) or k <= i + 1:
                continue
            since = max(i, previous.get(v["group_id"], i))
            closes = [rows[j][3] for j in range(since, k + 1)]
            if not any(v["d"] * (q - p) < 0 for p, q in zip(closes, closes[1:], strict=False)):
                continue
            before = rows[k - 1]
            if (b[3] > before[1] and b[3] > b[0]) if v["d"] == 1 else (b[3] < before[2] and b[3] < b[0]):
                found.append(((k + 1) * BAR, v["group_id"]))
                previous[v["group_id"]] = k
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_attempts_match_a_walk(spark, seed):
    rows = walk(300, seed, gaps={100, 200})
    seen = observe.observe(frame(spark, rows))
    versions = population.versions(observe.alternation(seen), seen)
    got = sorted((r.t1, r.group_id) for r in population.attempts(versions, seen).collect())
    assert got == plain_attempts(rows, [r.asDict() for r in versions.collect()], len(rows))


def test_outcomes_of_flat_future(spark):
    flat = [(100.0, 100.0, 100.0, 100.0, 1.0)] * 40
    flat[25], flat[30] = (100.0, 106.0, 100.0, 100.0, 1.0), (100.0, 100.0, 97.0, 100.0, 1.0)
    flat[39] = (100.0, 102.0, 100.0, 102.0, 1.0)
    seen = bars.segments(frame(spark, flat)).withColumn("a", F.lit(2.0)).withColumn("a_r", F.lit(None).cast("string"))
    got = {r.t0 // BAR: r for r in outcomes.forward(seen, 16).collect()}
    assert (got[23].final, got[23].up, got[23].down) == (1.0, 3.0, 1.5)
    assert got[24].flags == ["RIGHT_CENSORED"] and got[24].final is None
    start = spark.createDataFrame([("S", 20 * BAR, 21 * BAR, 1, 100.0, 2.0, 102.0, 98.0)], "series string, t0 long, t1 long, d int, c double, a double, f double, g double")
    touched = outcomes.first_touch(start, frame(spark, flat), 16).first()
    assert touched["class"] == "F_BEFORE_A" and (touched.f_bar, touched.g_bar) == (4, 9)


def test_outcomes_do_not_depend_on_blocks(spark, monkeypatch):
    seen = observe.observe(frame(spark, walk(300, 8, gaps={130, 131})))
    whole = sorted(map(str, outcomes.forward(seen, 16).collect()))
    monkeypatch.setattr(outcomes, "BLOCK_BARS", 1)  # blocks of 64 bars
    assert sorted(map(str, outcomes.forward(seen, 16).collect())) == whole and len(whole) == 300


def test_strict_sum_and_describe(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(measures.strict_sum(F.col("v")).alias("s")).collect()}
    assert got == {"a": None, "b": 5.0}
    row = spark.createDataFrame([(float(i),) for i in range(1, 5)], "v double").agg(*measures.describe(F.col("v"), (0.1, 0.25, 0.5, 0.9))).first()
    assert (row.p10, row.p25, row.p50, row.p90) == pytest.approx((1.3, 1.75, 2.5, 3.7))


def test_measure_reasons_travel(spark):
    rows = spark.createDataFrame([(1.0, 2.0, None), (1.0, 0.0, None), (1.0, None, "WHY")], "n double, v double, r string")
    got = rows.select(measures.ratio(F.col("n"), F.struct("v", "r")).alias("m")).collect()
    assert [(r.m.v, r.m.r) for r in got] == [(0.5, None), (None, "ZERO_DENOMINATOR"), (None, "WHY")]
