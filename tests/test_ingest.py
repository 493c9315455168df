"""Queries over market files against their SQL twins, on events with values that the given small tables lack."""

from datetime import datetime, timedelta

import duckdb
import pytest

from tidemark.plans import ingest

START = datetime(2024, 1, 5)
NAMES = ["ingest_coverage", "ingest_late_rows", "ingest_minutes", "ingest_problems"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two types over two rounds of the fifty places of faults: all zero, below zero, and from zero upwards."""
    rows, each = [], ((0.0,), (-2.5,), (0.0, 3.25), (7.5, 0.0), (1.0, 0.0, 2.0), (4.5,))
    for k in range(100):
        for kind, plus in (("a", 0), ("b", 3)):
            for i, value in enumerate(each[(k // 2 + plus) % len(each)]):
                rows.append((len(rows), START + timedelta(minutes=k, seconds=7 * i), kind, value))
    rows += [(len(rows), START + timedelta(minutes=k), kind, 0.0) for k in range(100, 150) for kind in "ab"]
    folder = tmp_path_factory.mktemp("ingest")
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    frame.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_zero_and_negative_values_are_no_fault(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet/*.parquet'")
    found = ingest.ALL[name](spark, str(tables))
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ingest.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


def test_of_equal_times_the_first_event_closes_a_minute(spark, tmp_path):
    rows = [(i, START + timedelta(minutes=i // 3), "a", float(i % 7 + 1)) for i in range(150)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = con.execute(f"SELECT t, c FROM ({ingest.ORACLE['ingest_minutes']}) ORDER BY t").fetchall()
    assert [tuple(r) for r in ingest.ingest_minutes(spark, str(tmp_path)).select("t", "c").orderBy("t").collect()] == wanted


@pytest.fixture(scope="module")
def other_months(spark, tmp_path_factory):
    """Minutes from the end of a year to its third month after, some with values that are null beside others."""
    rows = []
    for day in (datetime(2023, 12, 31, 23), datetime(2024, 1, 31, 23), datetime(2024, 3, 9)):
        for k in range(100):
            for i, value in enumerate((None, 1.5, 2.5, None) if k % 3 else (2.0,)):
                rows.append((len(rows), day + timedelta(minutes=k, seconds=7 * i), "ab"[k // 50], value))
    folder = tmp_path_factory.mktemp("months")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["ingest_late_rows", "ingest_problems"])
def test_events_of_other_months(spark, other_months, name):
    test_zero_and_negative_values_are_no_fault(spark, other_months, name)


@pytest.mark.parametrize("name", ["ingest_minutes", "ingest_problems"])
def test_values_that_are_not_finite_or_unknown_are_no_fault(spark, tmp_path, name):
    each = [(None,), (float("nan"),), (float("inf"),), (float("-inf"), None), (1.0, float("nan")), (-float("inf"), float("inf")), (2.0,)]
    rows = [(k * 10 + i, START + timedelta(minutes=k, seconds=7 * i), "a", v) for k in range(350) for i, v in enumerate(each[k % len(each)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    test_zero_and_negative_values_are_no_fault(spark, tmp_path, name)
