"""Stateful streaming against a walk over the same bars."""

from pyspark.sql import functions as F

from tidemark.streaming import live


def test_running_range_matches_a_walk(spark, tmp_path):
    rows = spark.range(60).select(
        F.lit("a").alias("series"), F.timestamp_seconds(F.col("id") * 60).alias("t0"), F.timestamp_seconds(F.col("id") * 60 + 60).alias("t1"),
        F.when(F.col("id") == 30, "INCOMPLETE").otherwise("COMPLETE").alias("status"),
        (10 + F.col("id") % 7).cast("double").alias("h"), (8 - F.col("id") % 3).cast("double").alias("l"), (9 + F.col("id") % 2).cast("double").alias("c"),
    )
    for i, part in enumerate((rows.filter("t0 < timestamp_seconds(1500)"), rows.filter("t0 >= timestamp_seconds(1500)"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    query = live.running_range(stream, 5).writeStream.format("memory").queryName("live_range").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r.t1: (r.tr, r.a) for r in spark.table("live_range").collect()}
    close, ranges, wanted = None, [], {}
    for r in rows.orderBy("t0").collect():
        if r.status != "COMPLETE":
            close, ranges = None, []
        tr = None if close is None else max(r.h - r.l, abs(r.h - close), abs(r.l - close))
        if tr is not None:
            ranges = [*ranges, tr][-5:]
        wanted[r.t1] = (tr, sum(ranges) / 5 if len(ranges) == 5 else None)
        close = r.c if r.status == "COMPLETE" else None
    assert got == wanted
