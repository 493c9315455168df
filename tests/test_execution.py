"""Contacts in a pyramid against a walk, and modelled execution on minutes case by case."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import execution, pyramid

MIN, DAY = 60_000, 86_400_000
T0 = 1_700_006_400_000
END = T0 + 3 * DAY
ENTRY = T0 + 10 * MIN


def test_first_contacts_match_a_walk(spark):
    rnd = random.Random(4)
    made = [(s, T0 + i * MIN, float(rnd.randint(0, 30)), rnd.random() < 0.03) for s in "ab" for i in range(300) if rnd.random() < 0.95]
    rows = spark.createDataFrame(made, "series string, t0 long, x double, bad boolean")
    tower = pyramid.build(rows, ["series"], MIN, F.col("x"), F.col("x"), F.col("bad"), fan=4)
    assert len(tower.levels) == 5
    asks = []
    for i in range(400):
        start = rnd.randint(0, 310)
        asks.append((rnd.choice("abc"), i, rnd.choice([pyramid.HIGH, pyramid.LOW, pyramid.MISSING]), float(rnd.randint(-1, 31)), start, start + rnd.choice([-1, 0, 3, 50, 1000])))
    asked = spark.createDataFrame(asks, "series string, id int, kind string, level double, start long, until long")
    got = {r.id: r.hit for r in pyramid.first_contact(tower, asked, fan=4).collect()}
    origin = min(r[1] for r in made)
    values = {(s, (t - origin) // MIN): (x, bad) for s, t, x, bad in made}
    for s, i, kind, level, start, until in asks:
        on = {pyramid.HIGH: lambda x, b: x >= level, pyramid.LOW: lambda x, b: x <= level, pyramid.MISSING: lambda x, b: b}[kind]
        hits = [p for p in range(start, min(until, 320) + 1) if (s, p) in values and on(*values[s, p])]
        assert got[i] == (hits[0] if hits else None), (s, kind, level, start, until)


def minutes(changes, end=END, missing=()):
    """Flat minutes at 108, but for some."""
    rows = []
    for t in range(T0, end, MIN):
        o, h, l, c = changes.get(t, (108.0, 108.05, 107.95, 108.0))  # noqa: E741
        gone = t in missing
        rows.append(("s", t, "INCOMPLETE" if gone else "COMPLETE", *((None,) * 4 if gone else (o, h, l, c))))
    return rows


#: Name: minutes that differ, stops (from, level), exit due, end, missing minutes; then reason, reference, minute, intrabar, both, at activation, final stop.
CASES = {
    "stop within a minute": ({ENTRY + 5 * MIN: (108.0, 108.1, 105.7, 106.0)}, [], None, END, (), ("STOP", 105.8, ENTRY + 5 * MIN, True, False, False, 105.8)),
    "open beyond the stop": ({ENTRY + 5 * MIN: (105.0, 105.2, 104.9, 105.1)}, [], None, END, (), ("STOP", 105.0, ENTRY + 5 * MIN, False, False, False, 105.8)),
    "both touched, stop first": ({ENTRY + 3 * MIN: (108.0, 112.5, 105.5, 109.0)}, [], None, END, (), ("STOP", 105.8, ENTRY + 3 * MIN, True, True, False, 105.8)),
    "entry and exit in one minute": ({ENTRY: (108.0, 108.2, 105.6, 106.0)}, [], None, END, (), ("STOP", 105.8, ENTRY, True, False, False, 105.8)),
    "target": ({ENTRY + 7 * MIN: (108.0, 112.0, 107.0, 111.0)}, [], None, END, (), ("TARGET", 112.0, ENTRY + 7 * MIN, True, False, False, 105.8)),
    "open beyond the target": ({ENTRY + 7 * MIN: (113.0, 113.0, 112.0, 112.5)}, [], None, END, (), ("TARGET", 113.0, ENTRY + 7 * MIN, False, False, False, 105.8)),
    "new stop from its minute on": (
        {ENTRY + 29 * MIN: (108.0, 108.1, 107.0, 107.5), ENTRY + 30 * MIN: (107.6, 107.8, 107.25, 107.5)}, [(ENTRY + 30 * MIN, 107.3)], None, END, (),
        ("STOP", 107.3, ENTRY + 30 * MIN, True, False, False, 107.3),
    ),
    "open beyond the new stop as it begins": ({ENTRY + 30 * MIN: (107.0, 107.1, 106.9, 107.0)}, [(ENTRY + 30 * MIN, 107.3)], None, END, (), ("STOP", 107.0, ENTRY + 30 * MIN, False, False, True, 107.3)),
    "time": ({}, [], None, END, (), ("TIME_EXIT", 108.0, ENTRY + DAY, False, False, False, 105.8)),
    "structure": ({}, [], ENTRY + 90 * MIN, END, (), ("EXIT_STRUCTURE", 108.0, ENTRY + 90 * MIN, False, False, False, 105.8)),
    "structure and time at once": ({}, [], ENTRY + DAY, END, (), ("EXIT_STRUCTURE", 108.0, ENTRY + DAY, False, False, False, 105.8)),
    "end of the minutes": ({}, [], None, ENTRY + 30 * MIN, (), ("END_OF_SEGMENT", 108.0, ENTRY + 29 * MIN, False, False, False, 105.8)),
    "missing minute": ({}, [], None, END, (ENTRY + 50 * MIN,), ("UNRESOLVED_DATA_GAP", None, ENTRY + 50 * MIN, False, False, False, 105.8)),
    "missing before an exit that is due": ({}, [], ENTRY + 50 * MIN, END, (ENTRY + 50 * MIN,), ("UNRESOLVED_DATA_GAP", None, ENTRY + 50 * MIN, False, False, False, 105.8)),
}


def executed(spark, case, sign=1):
    """The trade of a case; with sign -1 everything is mirrored about 108."""
    changes, more, due, end, missing, _ = CASES[case]
    flip = lambda x: x if sign == 1 or x is None else 216.0 - x
    rows = [(s, t, status, flip(o), *((flip(h), flip(low)) if sign == 1 else (flip(low), flip(h))), flip(c)) for s, t, status, o, h, low, c in minutes(changes, end, missing)]
    table = spark.createDataFrame(rows, "series string, t0 long, status string, o double, h double, l double, c double")
    trade = spark.createDataFrame(
        [("s", "leg", sign, ENTRY, flip(112.0), ENTRY + DAY, due, end - MIN)],
        "series string, leg_id string, d int, entry_at long, target double, time_exit long, exit_due long, last_t0 long",
    )
    edges = [(ENTRY, 105.8), *more]
    stops = spark.createDataFrame(
        [("s", "leg", sign, t, edges[i + 1][0] if i + 1 < len(edges) else None, flip(x)) for i, (t, x) in enumerate(edges)],
        "series string, leg_id string, d int, valid_from long, valid_to long, stop double",
    )
    return execution.execute(trade, stops, table, execution.minute_pyramid(table)).first()


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    r = executed(spark, case)
    assert (r.reason, r.reference, r.minute, r.intrabar, r.both, r.at_activation, r.final_stop) == CASES[case][-1]


@pytest.mark.parametrize("case", ["both touched, stop first", "open beyond the new stop as it begins", "new stop from its minute on", "open beyond the target"])
def test_cases_mirrored(spark, case):
    r, wanted = executed(spark, case, -1), CASES[case][-1]
    assert (r.reason, r.minute, *wanted[3:6]) == (wanted[0], wanted[2], r.intrabar, r.both, r.at_activation)
    assert r.reference == pytest.approx(216 - wanted[1]) and r.final_stop == pytest.approx(216 - wanted[6])


def test_quiet_minutes_are_flat_and_incomplete_bars_missing(spark):
    bars = spark.createDataFrame([("s", 0, 3 * MIN, "COMPLETE"), ("s", 3 * MIN, 6 * MIN, "INCOMPLETE"), ("s", 6 * MIN, 9 * MIN, "COMPLETE")], "series string, t0 long, t1 long, status string")
    found = spark.createDataFrame([("s", MIN, 1.0, 3.0, 0.5, 2.0), ("s", 7 * MIN, 5.0, 5.0, 5.0, 5.0)], "series string, t0 long, o double, h double, l double, c double")
    got = [(r.status == "COMPLETE", r.o, r.h, r.c) for r in execution.quiet_minutes(found, bars, 3 * MIN).orderBy("t0").collect()]
    none = (False, None, None, None)
    assert got == [none, (True, 1.0, 3.0, 2.0), (True, 2.0, 2.0, 2.0), none, none, none, (True, 2.0, 2.0, 2.0), (True, 5.0, 5.0, 5.0), (True, 5.0, 5.0, 5.0)]
