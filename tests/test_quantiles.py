"""Quantiles by selection against numpy: repeated values, far-apart values, hot groups, nulls."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles, scan, summary

QS = (0.0, 0.1, 0.5, 0.77, 1.0)


@pytest.fixture(autouse=True)
def selection(monkeypatch):
    monkeypatch.setattr(scan, "SMALL_BYTES", 0)


def rows():
    rnd = random.Random(3)
    groups = {
        "hot": [rnd.gauss(0, 1) for _ in range(3000)],
        "one": [4.25],
        "same": [7.0] * 50,
        "far": [10.0 ** rnd.randint(-200, 200) * rnd.choice([-1, 1]) for _ in range(300)],
        "few": [1.0, 2.0],
        "none": [None, None],
        None: [float(rnd.randint(0, 5)) for _ in range(500)] + [None] * 5,
    }
    made = [(g, x) for g, xs in groups.items() for x in xs]
    rnd.shuffle(made)
    return groups, made


@pytest.mark.parametrize("bins", [3, 4096])
def test_described_matches_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    groups, made = rows()
    if bins == 3:  # far-apart values take a pass for each factor of three
        groups.pop("far")
        made = [r for r in made if r[0] != "far"]
    frame = spark.createDataFrame(made, "g string, x double").repartition(4)
    found = quantiles.described(frame, ["g"], F.col("x"), QS)
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: r for r in found.collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        known = [x for x in xs if x is not None]
        assert got[g].n == len(known)
        for q in QS:
            have = got[g][f"p{round(q * 100)}"]
            assert have is None if not known else have == pytest.approx(np.quantile(known, q), rel=1e-12)


def test_selection_equals_the_aggregate(spark, monkeypatch):
    _, made = rows()
    frame = spark.createDataFrame([(g, str(i % 2), x) for i, (g, x) in enumerate(made) if g != "far"], "g string, h string, x double")
    one = summary.grouped(frame, ["g", "h"], "x", (0.1, 0.5, 0.9)).collect()
    monkeypatch.setattr(scan, "SMALL_BYTES", 1 << 40)
    two = summary.grouped(frame, ["g", "h"], "x", (0.1, 0.5, 0.9)).collect()
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(tuple, one), key=key) == sorted(map(tuple, two), key=key) and len(one) > 15


def test_no_rows(spark):
    assert quantiles.described(spark.createDataFrame([], "g string, x double"), ["g"], F.col("x"), QS).count() == 0
