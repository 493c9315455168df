"""Market files with every kind of bad row, published results, and streaming bars."""

import hashlib
import zipfile
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import asof, bars, outcomes, verify
from tidemark.sources import market, publish
from tidemark.streaming import live

LO = scalars.month_bounds("2024-01")[0]
HEADER = ",".join(market.MINUTE_COLUMNS)


def line(i, o=10.0, h=11.0, low=9.0, c=10.5, t=None, close=None):
    t = LO + i * 60_000 if t is None else t
    return f"{t},{o},{h},{low},{c},1,{t + 59_999 if close is None else close},2,3,0.5,0.5,0"


def write(folder, lines, name="X-2024-01"):
    with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
        z.writestr(f"{name}.csv", "\n".join(lines) + "\n")
    return [str(folder / f"{name}.zip")]


def test_every_bad_row_is_named(spark, tmp_path):
    rows = [
        HEADER, line(0), line(1), line(1), line(2), line(2, c=10.6), line(3, h=9.5), line(3), line(4).replace("10.5", "abc"), line(5).replace("10.5", "abc"), line(5),
        "1,2,3", line(6).replace(str(LO + 6 * 60_000), "x", 1), line(7, close=1), line(0, t=LO - 60_000), "", line(0),
    ]
    parsed = market.in_month(market.minute_rows(market.read_lines(spark, write(tmp_path, rows))))
    problems = {r.problem: r["count"] for r in parsed.groupBy("problem").count().collect()}
    assert problems == {None: 8, "PRICES_INCONSISTENT": 1, "VALUE_NOT_NUMERIC": 2, "FIELD_COUNT": 1, "TIME_NOT_INTEGER": 1, "TIME_NOT_MINUTE_ALIGNED": 1, "OUTSIDE_FILE_MONTH": 1}
    assert market.out_of_order(parsed.filter("problem is null or problem in ('VALUE_NOT_NUMERIC', 'PRICES_INCONSISTENT')")).filter("late").count() == 5
    grid = {(r.t - LO) // 60_000: r.status for r in market.minute_grid(market.minutes(parsed), LO, LO + 8 * 60_000).collect()}
    assert grid == {0: "VALID", 1: "VALID", 2: "INVALID", 3: "INVALID", 4: "INVALID", 5: "VALID", 6: "MISSING", 7: "MISSING"}
    covered = bars.coverage(market.minute_grid(market.minutes(parsed), LO, LO + 8 * 60_000)).first()
    assert (covered.expected, covered.valid, covered.missing, covered.invalid) == (8, 3, 2, 3)


@pytest.mark.parametrize("rows", [["a,b,c", line(0)], [HEADER, line(0, t=LO * 1000)]])
def test_wrong_files_fail(spark, tmp_path, rows):
    with pytest.raises(Exception, match="unknown header|not milliseconds"):
        market.minute_rows(market.read_lines(spark, write(tmp_path, rows))).collect()


def test_zip_must_hold_its_own_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "Y-2024-01.zip", "w") as z:
        z.writestr("other.csv", "x")
    with pytest.raises(Exception, match="members"):
        market.read_lines(spark, [str(tmp_path / "Y-2024-01.zip")]).collect()


@pytest.mark.parametrize(
    ("taus", "kinds"),
    [
        ([0, 8, 16], set()),
        ([], {"EMPTY"}),
        ([0, 16], {"INTERVAL_MISMATCH"}),
        ([9, 17], {"START_COVERAGE"}),
        ([0, 8], {"END_COVERAGE"}),
        ([0, 8, 8, 16], {"DUPLICATE_TIMESTAMP"}),
    ],
)
def test_funding_is_certified_or_says_why(spark, tmp_path, taus, kinds):
    lines = [",".join(market.FUNDING_COLUMNS)] + [f"{LO + t * 3_600_000},8,0.0001" for t in taus]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    rows = market.funding_rows(market.read_lines(spark, [str(tmp_path / "f.csv")]))
    found = market.funding_anomalies(rows, LO, LO + 24 * 3_600_000)
    assert {r.kind for r in found.collect()} == kinds
    if kinds:
        with pytest.raises(ValueError):
            market.require_empty(found, "funding")


def test_conflicting_and_corrupt_funding(spark, tmp_path):
    (tmp_path / "f.csv").write_text(f"{LO},8,0.1\n{LO},8,0.2\nx,8,0.1\n{LO + 1},0,0.1\n")
    rows = market.funding_rows(market.read_lines(spark, [str(tmp_path / "f.csv")]))
    found = {r.kind: r["count"] for r in market.funding_anomalies(rows, LO, LO + 8 * 3_600_000).collect()}
    assert found == {"CONFLICTING_DUPLICATE": 2, "CORRUPT_ROWS": 2}


def test_verified_placement(spark, tmp_path):
    source = tmp_path / "in.bin"
    source.write_bytes(b"payload")
    digest = hashlib.sha256(b"payload").hexdigest()
    assert market.parse_checksum(f"{digest}  in.bin\n", "in.bin") == digest
    with pytest.raises(market.SchemaError):
        market.parse_checksum(f"{digest}  other.bin", "in.bin")
    assert market.place(str(source), str(tmp_path / "out.bin"), digest)
    assert not market.place(str(source), str(tmp_path / "out.bin"), digest)
    with pytest.raises(market.SchemaError):
        market.place(str(source), str(tmp_path / "bad.bin"), "0" * 64)
    found = market.file_hashes(spark, [str(tmp_path / "out.bin")])
    manifest = spark.createDataFrame([("out.bin", digest), ("gone.bin", digest)], "file string, sha256 string")
    assert [r.file for r in market.unverified(found, manifest).collect()] == ["gone.bin"]
    assert market.month_paths("d", "X", LO, LO + 40 * 86_400_000) == ["d/X-2024-01.zip", "d/X-2024-02.zip"]
    assert market.missing_months(["2024-01"], LO, LO + 40 * 86_400_000) == ["2024-02"]


def test_synthetic_minutes_are_a_walk_and_repeat(spark):
    a, b = (market.synthetic_minutes(spark, "2024-02", 7).repartition(n).orderBy("t").collect() for n in (2, 5))
    assert len(a) == 29 * 1440 and [r.t for r in a] == [r.t for r in b]
    assert [r.c for r in a] == pytest.approx([r.c for r in b])
    assert all(x.c == pytest.approx(y.o) and y.l <= min(y.o, y.c) and y.h >= max(y.o, y.c) for x, y in zip(a, a[1:], strict=False))


def test_publish_and_catalogue(spark, tmp_path):
    base = str(tmp_path / "runs")
    data = spark.createDataFrame([("a", 1, (1.5, None)), ("b", 2, (None, "WHY"))], "k string, n int, m struct<v:double,r:string>")
    run = publish.publish({"x": data}, base, {"p": 1}, {"in": "0"})
    assert publish.publish({"x": data.repartition(3)}, base, {"p": 1}, {"in": "0"}) == run
    assert [(r.run, r.dataset, r.rows) for r in publish.catalogue(spark, base).collect()] == [(run, "x", 2)]
    assert publish.open_result(spark, base, run, "x").count() == 2
    data.limit(1).write.mode("overwrite").parquet(f"{base}/{run}/x")
    with pytest.raises(ValueError):
        publish.open_result(spark, base, run, "x")
    publish.write_csv(data, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["k", "n", "m", "m_reason"]
    assert "| a | 1 |" in publish.markdown(data.select("k", "n"))
    packed = publish.columnar(data.select("k", "n"), "k", "n").orderBy("k").first()
    assert packed.n == [1]


def test_steps_against_fractions(spark):
    values = [Decimal(x) for x in ("0.00", "0.01", "-0.01", "0.24", "0.25", "-0.26", "123.45", "-123.45")]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(18,2)")
    for step in (Decimal("0.25"), Decimal("0.1"), Decimal("3")):
        got = df.select("v", scalars.floor_to_step(F.col("v"), step).alias("lo"), scalars.ceil_to_step(F.col("v"), step).alias("hi")).collect()
        for r in got:
            units = Fraction(r.v) / Fraction(step)
            assert Fraction(r.lo) == (units.numerator // units.denominator) * Fraction(step)
            assert Fraction(r.hi) == -((-units.numerator) // units.denominator) * Fraction(step)


def test_times(spark):
    rows = spark.createDataFrame([("2024-02-29T12:34:56Z", -7), ("2024-02-29T12:34:56+01:00", 5)], "s string, t long")
    got = rows.select(scalars.parse_utc(F.col("s")).alias("p"), scalars.interval_start(F.col("t"), 3).alias("i")).collect()
    assert got[0].p == 1_709_210_096_000 and got[1].p is None and [r.i for r in got] == [-9, 3]
    back = rows.select(scalars.iso(F.lit(1_709_210_096_000)).alias("s"), scalars.month_of(F.lit(-1)).alias("m")).first()
    assert back.s == "2024-02-29T12:34:56Z" and back.m == "1969-12"


def test_interval_join_and_overlap(spark):
    points = spark.createDataFrame([("a", i) for i in range(0, 100, 7)], "k string, t long")
    spans = spark.createDataFrame([("a", 10, 30, 1), ("a", 25, 60, 2), ("b", 0, 99, 3)], "k string, lo long, hi long, id int")
    got = sorted((r.t, r.id) for r in asof.interval_join(points, spans, ["k"], "t", "lo", "hi", 16).collect())
    assert got == sorted((t, i) for t in range(0, 100, 7) for lo, hi, i in ((10, 30, 1), (25, 60, 2)) if lo <= t <= hi)
    windows = spark.createDataFrame([(5, 11), (60, 70)], "a long, b long")
    assert {r.id for r in asof.overlapping(spans, windows, "lo", "hi", "a", "b", 16).collect()} == {1, 3}


def test_open_spans_overlap(spark):
    spans = spark.createDataFrame([(10, None, 1), (30, None, 2), (0, 5, 3)], "lo long, hi long, id int")
    windows = spark.createDataFrame([(20, 25)], "a long, b long")
    assert [r.id for r in asof.overlapping(spans, windows, "lo", "hi", "a", "b", 8).collect()] == [1]
    assert asof.overlapping(spans, windows.limit(0), "lo", "hi", "a", "b", 8).count() == 0


def test_case_windows_hold_the_bars_around(spark):
    rows = [("a", t, 1.0, 2.0, 0.5, float(t)) for t in range(1, 60)]
    frame = spark.createDataFrame(rows, "series string, t1 long, o double, h double, l double, c double")
    cases = spark.createDataFrame([("a", 7, 20), ("a", 8, 59), ("b", 9, 20)], "series string, case_id int, at long")
    got = {r.case_id: r for r in publish.case_windows(cases, frame, ["series"], "at", 5, 3).collect()}
    assert set(got) == {7, 8}
    assert [x.t1 for x in got[7].known] == [16, 17, 18, 19, 20] and [x.t1 for x in got[7].later] == [21, 22, 23]
    assert [x.t1 for x in got[8].later] == []


def test_projections_change_only_what_they_say(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, k string, v double")
    same = before.withColumn("v", F.col("v") + 1)
    assert verify.unchanged(before, same, ["v"]).count() == 0
    other = same.withColumn("k", F.when(F.col("id") == 2, "c").otherwise(F.col("k")))
    assert {(r.id, r.side) for r in verify.unchanged(before, other, ["v"]).collect()} == {(2, "before"), (2, "after")}
    assert [r[0] for r in spark.range(1).select(outcomes.origins(0, 100, 25)).collect()] == [0, 25, 50, 75]


def test_late_ticks_are_counted(spark, tmp_path):
    times = [0, 600, 1200, 3600], [4000], [4600, 10, 20]  # late is what lies behind the watermark that the batch before had
    for i, part in enumerate(times):
        rows = [("a", t, 1.0, 1.0) for t in part]
        frame = spark.createDataFrame(rows, "series string, t long, price double, qty double").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    query = live.stream_bars(stream, "10 minutes", "1 minute").writeStream.format("memory").queryName("live_late").outputMode("append").start()
    query.processAllAvailable()
    assert live.late_ticks(query) >= 1
    query.stop()


def test_stream_bars_match_batch(spark, tmp_path):
    ticks = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("series"), F.timestamp_seconds(F.col("id") * 7 + 1_700_000_000).alias("ts"),
        (F.col("id") % 13).cast("double").alias("price"), F.lit(1.0).alias("qty"),
    )
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    query = live.stream_bars(stream, "10 minutes", "1 minute").writeStream.format("memory").queryName("live_bars").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("live_bars").collect()
    wanted = ticks.groupBy("series", F.window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("h")).collect()
    full = {(r.series, r.w.start): (r.n, r.h) for r in wanted}
    assert len(got) >= len(full) - 4 and all(full[r.series, r.t0] == (r.ticks, r.h) for r in got)


def test_funding_is_certified_for_each_series(spark):
    """Two files that fill each other's gaps are two faulty series, not one whole one."""
    hour = 3_600_000
    rates = [LO + i * 8 * hour for i in range(6)]
    rows = [("even", t, 8.0, 0.1, None) for t in rates[::2]] + [("odd", t, 8.0, 0.1, None) for t in rates[1::2]]
    rows += [("whole", t, 8.0, 0.1, None) for t in rates] + [("bad", None, None, None, "ROW_NOT_PARSABLE")]
    frame = spark.createDataFrame(rows, "file string, tau long, hours double, rate double, problem string")
    found = sorted((r.file, r.kind, r.tau) for r in market.funding_anomalies(frame, LO, LO + 48 * hour, ("file",)).collect() if r.tau is not None)
    assert [(f, k) for f, k, _ in found] == [("even", "END_COVERAGE"), *[("even", "INTERVAL_MISMATCH")] * 2, *[("odd", "INTERVAL_MISMATCH")] * 2]
    rest = {(r.file, r.kind, r["count"]) for r in market.funding_anomalies(frame, LO, LO + 48 * hour, ("file",)).collect() if r.tau is None}
    assert rest == {("bad", "CORRUPT_ROWS", 1), ("bad", "EMPTY", 1)}
