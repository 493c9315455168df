"""Pfair schedules against a slot-by-slot simulation and the deviation they promise."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from tidemark.llm import mixing

SCHEMA = "doc_id long, source string, slot string, row string"


def apportioned(parts, t):
    """Blocks of each source by slot t: whole shares, one more for the largest remainders."""
    total = sum(parts)
    had = [p * t // total for p in parts]
    left = sorted(range(len(parts)), key=lambda i: (-(parts[i] * t % total), i))
    for i in left[: t - sum(had)]:
        had[i] += 1
    return had


def simulate(parts, frame, frames):
    """Slot by slot: of the released blocks of a frame the one that is due first."""
    total, order = sum(parts), []
    for start in range(0, frame * frames, frame):
        given, end = apportioned(parts, start), apportioned(parts, start + frame)
        for t in range(start, start + frame):
            ready = [(-((j + 1) * total // -p), i) for i, (p, j) in enumerate(zip(parts, given, strict=True)) if j < end[i] and j * total // p <= t]
            _, i = min(ready)
            order.append((i, given[i]))
            given[i] += 1
    return order


CASES = {
    "one hot and 100 small": ([900] + [1] * 100, 1024, 50),
    "uneven": ([random.Random(3).randint(1, 99) for _ in range(40)], 256, 50),
    "two": ([9999, 1], 1024, 50),
    "one": ([5], 16, 3),
}


@pytest.mark.parametrize("case", CASES)
def test_schedule_matches_simulation_and_stays_within_a_block(spark, case):
    weights, frame, frames = CASES[case]
    members = [w for w in weights if w * frame >= sum(weights)]
    names = [f"s{i:03}" for i in range(len(weights))]
    parts = {r.source: r.part for r in mixing.whole_parts(spark.createDataFrame(list(zip(names, map(float, weights))), "source string, weight double")).collect()}
    total, slots = sum(parts.values()), frame * frames
    sizes = [(n, parts[n], max(1, slots * parts[n] // total)) for n in names]
    rows = mixing.block_slots(spark.createDataFrame(sizes, "source string, part bigint, blocks bigint"), frame).collect()
    placed = {r.slot: (r.source, r.block) for r in rows}
    assert len(placed) == len(rows)
    order = [placed[t] for t in range(slots - frame)]  # no slot is empty while all sources have blocks
    if len(members) == len(weights):
        heavy = sorted(names, key=lambda n: (parts[n], n))
        assert order == [(heavy[i], j) for i, j in simulate([parts[n] for n in heavy], frame, frames - 1)]
    given, worst = Counter(), Counter()
    for t, (source, block) in enumerate(order):
        assert block == given[source]
        share = Fraction(weights[names.index(source)], sum(weights))
        before, given[source] = abs(given[source] - share * t), given[source] + 1
        worst[source] = max(worst[source], before, abs(given[source] - share * (t + 1)))
    for name, w in zip(names, weights, strict=True):  # between its blocks a source only falls back, to where the next is taken
        assert worst[name] < (1 if w * frame >= sum(weights) else 2)


def test_sources_without_a_weight_have_the_least(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "", "") for i in range(900)], SCHEMA)
    weights = spark.createDataFrame([("a", 3.0), ("b", None), ("unused", 9.0)], "source string, weight double")
    planned = mixing.schedule(docs, weights, block_rows=10).collect()
    assert len(planned) == 900 and len({(r.slot, r.row_in_block) for r in planned}) == 900


def test_every_row_has_one_place(spark):
    rnd = random.Random(8)
    rows = [(i % 900 if i % 97 else None, rnd.choice(["hot"] * 6 + ["a", "b", None, "c"]), "x", "y") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    planned = mixing.schedule(docs, block_rows=10, frame=64).collect()
    assert sorted(str(tuple(r.row)) for r in planned) == sorted(map(str, rows))
    assert len({(r.slot, r.row_in_block) for r in planned}) == len(rows)
    owners = {}
    for r in planned:
        assert owners.setdefault(r.slot, (r.row.source, r.block)) == (r.row.source, r.block)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == len(rows)


def test_mixed_is_in_slot_order(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "", "") for i in range(1000)], SCHEMA)
    got = [r.doc_id for r in mixing.mixed(docs).collect()]
    plan = {r.doc_id: (r.slot, r.row_in_block) for r in mixing.mix_plan(docs).collect()}
    assert got == sorted(plan, key=plan.get)


def test_empty_table(spark):
    assert mixing.mix_plan(spark.createDataFrame([], SCHEMA)).count() == 0
