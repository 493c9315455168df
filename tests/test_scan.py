"""Running values over blocks against walks, as-of joins over blocks, and plans without a window for a whole series."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, observe, population, scan, summary

BAR = 60_000


@pytest.fixture(autouse=True)
def blocks(monkeypatch):
    """No frame is few, so blocks are used."""
    monkeypatch.setattr(scan, "SMALL_BYTES", 0)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    made = [(k, t, rnd.choice([None, rnd.randint(-9, 9)])) for k in ("a", "b", None) for t in sorted(rnd.sample(range(-50, 300), 120))]
    return made, spark.createDataFrame(made, "k string, t long, x int").repartition(5)


@pytest.mark.parametrize("span", [7, 1000])
def test_running_values_match_a_walk(rows, span):
    made, frame = rows
    runs = {f"{kind}{int(b)}": getattr(scan, kind)(F.col("x"), before=b) for kind in ("total", "greatest", "least", "last") for b in (False, True)}
    got = {(r.k, r.t): r for r in scan.running(frame, ["k"], ["t"], scan.block_of("t", span), runs).collect()}
    assert len(got) == len(made)
    folds = {"total": sum, "greatest": max, "least": min, "last": lambda xs: xs[-1]}
    for key in ("a", "b", None):
        seen = []
        for k, t, x in made:
            if k != key:
                continue
            now = [*seen, x] if x is not None else seen
            for kind, fold in folds.items():
                assert got[k, t][f"{kind}1"] == (fold(seen) if seen else None)
                assert got[k, t][f"{kind}0"] == (fold(now) if now else None)
            seen = now


@pytest.mark.parametrize("span", [7, 40, 10_000])
def test_asof_join_matches_a_walk(spark, rows, span):
    made, frame = rows
    rnd = random.Random(6)
    facts = [(k, rnd.randint(-80, 320), i) for i, k in enumerate(rnd.choices(["a", "b", "c"], k=60))] + [("a", None, 999)]
    found = asof.asof_join(frame, spark.createDataFrame(facts, "k string, at long, v int"), ["k"], "t", "at", "f_", span).collect()
    assert len(found) == len(made)
    for r in found:
        known = [(t, v) for k, t, v in facts if k == r.k and t is not None and t <= r.t]
        assert (r.f_at, r.f_v) == (max(known) if known else (None, None))


def series(spark, n=400):
    rnd, price, made = random.Random(9), 100.0, []
    for name in ("a", "b"):
        for i in range(n):
            if rnd.randrange(60) == 0:
                made.append((name, i * BAR, (i + 1) * BAR, "INCOMPLETE", *[None] * 5))
                continue
            o, price = price, price + rnd.choice([-2.0, -1.0, 0.0, 1.0, 2.0])
            made.append((name, i * BAR, (i + 1) * BAR, "COMPLETE", o, max(o, price) + rnd.random(), min(o, price) - rnd.random(), price, 1.0))
    return spark.createDataFrame(made, "series string, t0 long, t1 long, status string, o double, h double, l double, c double, v double")


CONV = observe.Conventions(tr=3, fast=3, slow=5, lag=2, volume=3)


def test_observations_do_not_depend_on_blocks(spark, monkeypatch):
    made = series(spark)
    key = lambda r: (r.series, r.t0)
    seen = [sorted(observe.observe(made, CONV, n).collect(), key=key) for n in (7, 4096)]
    monkeypatch.setattr(scan, "SMALL_BYTES", 64 << 20)
    seen.append(sorted(observe.observe(made, CONV).collect(), key=key))
    assert seen[0] == seen[1] == seen[2] and {r.structure for r in seen[0]} >= {"UP", "DOWN", "MIXED"}
    assert sum(r.p0 is not None for r in seen[0]) > 300


def test_attempts_do_not_depend_on_blocks(spark, monkeypatch):
    made, found = series(spark), []
    for small, size in ((0, 7), (0, 4096), (64 << 20, 4096)):
        monkeypatch.setattr(scan, "SMALL_BYTES", small)
        seen = observe.observe(made, CONV, size)
        tried = population.attempts(population.versions(observe.alternation(seen, size), seen), seen, size)
        plan = tried._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Join Inner, .*segment#\d+L? = segment#\d+", plan)
        found.append(sorted(map(str, tried.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 20


def test_alternation_matches_a_walk(spark):
    made = observe.pivots(bars.segments(series(spark), 7), CONV)
    got = sorted(observe.alternation(made, 7).collect(), key=lambda r: (r.series, r.t0))
    state, version, walked = [], 0, []
    before = None
    for r in got:
        if before != (r.series, r.segment):
            state = []
            version = version if before and before[0] == r.series else 0
            before = (r.series, r.segment)
        if not state or state[-1][0] != r.kind:
            action, state = "APPEND", [*state, (r.kind, r.price)]
        elif (r.price > state[-1][1]) if r.kind == "HIGH" else (r.price < state[-1][1]):
            action, state = "REPLACE", [*state[:-1], (r.kind, r.price)]
        else:
            action = "KEEP"
        version += action != "KEEP"
        walked.append((action, version, state[-1], state[-2] if len(state) > 1 else None))
    assert [(r.action, r.version, (r.p1.kind, r.p1.price), (r.p0.kind, r.p0.price) if r.p0 else None) for r in got] == walked
    assert {w[0] for w in walked} == {"APPEND", "REPLACE", "KEEP"}


def test_overlap_and_drawdown_in_small_blocks(spark):
    rnd = random.Random(2)
    spans = [(k, a, a + rnd.randint(0, 40)) for k in "ab" for a in (rnd.randint(0, 500) for _ in range(40))]
    spans += [("a", 900, 950), ("a", 900, 950), ("b", 900, 900), ("b", 900, 900)]
    got = {r.k: r for r in population.overlap(spark.createDataFrame(spans, "k string, lo long, hi long"), ["k"], "lo", "hi", 50).collect()}
    for k in "ab":
        own = [(a, b) for x, a, b in spans if x == k]
        moves = sorted([(a, 1) for a, _ in own] + [(b, -1) for _, b in own])
        level, peak = 0, 0
        for _, step in moves:
            level += step
            peak = max(peak, level)
        meet = sum(any(i != j and c < b and a < d for j, (c, d) in enumerate(own)) for i, (a, b) in enumerate(own))
        assert (got[k].peak, got[k].spans) == (peak, len(own)) and abs(got[k].overlapping - meet) <= 2  # empty spans inside others
    nets = [("x", i * 10, float(rnd.randint(-9, 9))) for i in range(100)]
    frame = spark.createDataFrame(nets, "book string, at long, net double")
    path = {r["at"]: r for r in summary.drawdown_path(frame, ["book"], "at", "net", 70).collect()}
    equity, top, streak, longest = 0.0, 0.0, 0, 0
    for _, at, net in nets:
        equity += net
        top = max(top, equity)
        streak = streak + 1 if net < 0 else 0
        longest = max(longest, streak)
        assert (path[at].equity, path[at].peak) == (equity, top)
    assert summary.losing_streak(frame, ["book"], "at", "net", 70).first().longest == longest


def test_no_window_takes_a_whole_series(spark):
    """Windows over rows are partitioned by a block; those over blocks order blocks alone."""
    found = observe.observe(series(spark, 50), CONV)
    for frame in (found, observe.alternation(found), bars.segments(series(spark, 50))):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        for part, order in re.findall(r"Window \[.*\], \[(series#[^\]]*)\], \[([^\]]*)\]", plan):
            assert "segment" in part or scan.BLOCK in part or order.startswith(scan.BLOCK), (part, order)
