"""The live observer against the batch over the same ticks: any order of arrival, restarts, gaps, late ticks."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, observe
from tidemark.streaming import observer

MINUTE = 60_000
WIDTH = 30 * MINUTE
CONV = observe.Conventions(tr=5, fast=4, slow=9, lag=2, volume=5, side=2)
SCHEMA = "series string, ts timestamp, t bigint, at bigint, price double, qty double"


@pytest.fixture(scope="module")
def rows():
    """Six days of two series with ties, flat stretches and gaps."""
    rnd, out = random.Random(11), []
    for series, gap in (("a", 40), ("b", 25)):
        price = 100.0
        for i in range(6 * 48):
            if rnd.randrange(gap) == 0:
                continue
            for _ in range(rnd.randint(1, 3)):
                price += rnd.choice([-1.0, 0.0, 0.0, 1.0, 2.0, -2.0])
                t = 1_700_006_400_000 + i * WIDTH + rnd.randrange(WIDTH)
                out.append((series, t, t * 1000 + rnd.randrange(1000), max(price, 1.0), float(rnd.randint(0, 4))))
    return out


def batch(spark, rows):
    ticks = spark.createDataFrame(rows, "series string, t bigint, at bigint, price double, qty double")
    return observer.spread(observe.observe(bars.aggregate(ticks, WIDTH), CONV))


def written(spark, rows, folder, chunks):
    """Files in the order in which the stream reads them."""
    for i, chunk in enumerate(chunks):
        made = spark.createDataFrame(chunk, "series string, t bigint, at bigint, price double, qty double")
        made.select("series", F.timestamp_millis("t").alias("ts"), "t", "at", "price", "qty").coalesce(1).write.parquet(f"{folder}/part{i:03d}")


def run(spark, folder, out, late, times=1):
    """Run the stream to the end of what is there; ``times`` starts from the same checkpoint."""
    for _ in range(times):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")
        with observer.state_store(spark):
            query = observer.observe_stream(stream, WIDTH, late, conv=CONV).writeStream.format("parquet").option("checkpointLocation", f"{out}/check")
            query.outputMode("append").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def compare(found, wanted, upto):
    """Rows that were over by ``upto``, to nine digits."""
    def rows_of(df):
        cut = {}
        for r in df.collect():
            if r.t1 <= upto:
                assert (r.series, r.t0) not in cut
                cut[r.series, r.t0] = tuple(round(v, 9) if isinstance(v, float) else v for v in r)
        return cut

    got, due = rows_of(found), rows_of(wanted)
    assert got.keys() == due.keys()
    for k, row in due.items():
        assert got[k] == row, [(n, a, b) for n, a, b in zip(wanted.columns, got[k], row, strict=True) if a != b]


END = 1_700_006_400_000 + 6 * 48 * WIDTH


def clock(rows):
    """A tick after all others, to push the watermark to the end of the last day."""
    return [*rows, [("clock", END + 6 * 3_600_000, 0, 1.0, 1.0)]]


@pytest.mark.parametrize("order", ["sorted", "reversed in chunks", "shuffled within lateness"])
def test_stream_equals_batch(spark, rows, tmp_path, order):
    by_time = sorted(rows, key=lambda r: r[1])
    size = len(by_time) // 5 + 1
    chunks = [by_time[i : i + size] for i in range(0, len(by_time), size)]
    late = "0 seconds"
    if order == "reversed in chunks":
        chunks = [list(reversed(c)) for c in chunks]
    if order == "shuffled within lateness":
        late, rnd = "6 hours", random.Random(1)
        moved = sorted(by_time, key=lambda r: r[1] + rnd.randrange(5 * 3_600_000))
        chunks = [moved[i : i + size] for i in range(0, len(moved), size)]
    written(spark, rows, str(tmp_path), clock(chunks))
    found = run(spark, str(tmp_path), str(tmp_path / "out"), late)
    wanted = batch(spark, rows)
    assert {r.structure for r in wanted.select("structure").distinct().collect()} >= {"UP", "DOWN", "MIXED"}
    compare(found.filter("series <> 'clock'"), wanted, END)


def test_restart_goes_on_where_it_was(spark, rows, tmp_path):
    by_time = sorted(rows, key=lambda r: r[1])
    half = len(by_time) // 2
    written(spark, rows, str(tmp_path), [by_time[:half]])
    first = run(spark, str(tmp_path), str(tmp_path / "out"), "0 seconds").count()
    assert 0 < first
    for i, chunk in enumerate(clock([by_time[half:]])):
        made = spark.createDataFrame(chunk, "series string, t bigint, at bigint, price double, qty double")
        made.select("series", F.timestamp_millis("t").alias("ts"), "t", "at", "price", "qty").coalesce(1).write.parquet(f"{tmp_path}/part1{i:02d}")
    found = run(spark, str(tmp_path), str(tmp_path / "out"), "0 seconds", times=2)
    compare(found.filter("series <> 'clock'"), batch(spark, rows), END)


def test_late_and_broken_ticks_change_nothing(spark, rows, tmp_path):
    """A tick is taken in until its bar is closed, in the run after the one that moved the watermark."""
    by_time = sorted(rows, key=lambda r: r[1])
    third = len(by_time) // 3
    late = [("a", by_time[10][1], 5, 1e9, 1.0), ("a", by_time[2 * third + 5][1], 5, None, 1.0)]
    written(spark, rows, str(tmp_path), clock([by_time[:third], by_time[third : 2 * third], [*late, *by_time[2 * third :]]]))
    found = run(spark, str(tmp_path), str(tmp_path / "out"), "0 seconds")
    compare(found.filter("series <> 'clock'"), batch(spark, rows), END)
