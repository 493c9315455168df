"""First contacts and chains against plain walks."""

import random

import pytest

from tidemark.operators import search


@pytest.mark.parametrize("block", [2, 64])
def test_first_reach_matches_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rnd = random.Random(block)
    rows = {k: [rnd.choice([None, rnd.randint(0, 30)]) for _ in range(rnd.choice([1, 40, 300]))] for k in "abc"}
    asks = [(i, rnd.choice("abcd"), rnd.choice([None, rnd.randint(-1, 300)]), rnd.choice([None, float(rnd.randint(5, 31))]), rnd.random() < 0.5) for i in range(200)]
    data = [(k, i, None if v is None else float(v)) for k, vs in rows.items() for i, v in enumerate(vs)]
    found = search.first_reach(
        spark.createDataFrame(data, "k string, pos long, value double"),
        spark.createDataFrame(asks, "id int, k string, after long, level double, strict boolean"),
        ["k"],
    )
    got = {r.id: r.hit for r in found.collect()}
    for i, k, after, level, strict in asks:
        hits = [p for p, v in enumerate(rows.get(k, [])) if None not in (v, after, level) and p > after and (v > level or (v == level and not strict))]
        assert got[i] == (min(hits) if hits else None)


@pytest.mark.parametrize("links", [3, 512])
def test_chain_matches_a_walk(spark, monkeypatch, links):
    monkeypatch.setattr(search, "LINKS", links)
    rnd = random.Random(links)
    data, wanted = [], set()
    for k in "abcd":
        n = rnd.choice([1, 5, 60])
        then = {i: rnd.choice([None, rnd.randint(i + 1, min(n, i + 6))] if rnd.random() < 0.05 else [rnd.randint(i + 1, min(n, i + 6))]) if i < n else None for i in range(1, n + 1)}
        data += [(k, i, t) for i, t in then.items()]
        at = 1
        while at is not None:
            wanted.add((k, at))
            at = then[at]
    found = search.chain(spark.createDataFrame(data, "k string, idx long, next long"), ["k"])
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
