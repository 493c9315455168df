"""Queries over streams: the tables are read as streams, written by a streaming query, and its rows are returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import epoch_ms
from tidemark.plans import oracle
from tidemark.plans.queries import WIDTH, r6
from tidemark.sources.shared import shared_dir
from tidemark.streaming import observer

_MEASURES = ("tr", "a", "sma_fast", "sma_slow", "dist", "slope", "place", "v_ratio", "pivot_price", "high_last", "low_last", "u")
_PLAIN = ("series", "t0", "t1", "status", "segment", "pos", "cross", "cross_r", "v_ratio_r", "high_check", "low_check", "pivot_kind", "structure", "structure_r", "version", "anchors_r")


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of ticks of their types."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a stream's path may not be a single file
    t = epoch_ms(F.col("ts"))
    micros = F.pmod((F.date_part(F.lit("SECOND"), "ts") * 1_000_000).cast("long"), F.lit(1000))
    return events.select(
        F.col("event_type").alias("series"), F.timestamp_millis(t).alias("ts"), t.alias("t"), (t * 1000 + micros).alias("at"), F.col("value").alias("price"), F.lit(1.0).alias("qty")
    )


def live_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a live observer has made of the ticks: the bars that were over at the last tick of all."""
    folder = shared_dir(spark)
    with observer.state_store(spark):
        made = observer.observe_stream(tick_stream(spark, sf_dir), WIDTH, "0 seconds")
        query = made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append")
        query.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/rows").select(*_PLAIN, *r6(*_MEASURES))


ALL = {"live_observations": live_observations}

_SELECT = ", ".join({"segment": "CAST(segment AS BIGINT) AS segment", "version": "CAST(version AS BIGINT) AS version", "cross": '"cross"'}.get(c, c) for c in _PLAIN)
ORACLE = {
    "live_observations": oracle.observed_sql(f"SELECT {_SELECT}, {oracle.r6(*_MEASURES)} FROM obs WHERE t1 <= (SELECT max(epoch_us(ts) // 1000) FROM events)"),
}
