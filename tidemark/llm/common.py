"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset a folder in /tmp is set, but only if
    driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in the lineage that survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dense_index(
    df: DataFrame, keys: Iterable[str], order: Iterable[str], bucket_rows: int, out: str, salt: Iterable[str]
) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... without gathering a key in one task.

    Rows go to buckets by the hash of ``salt`` (columns that tell rows apart), about ``bucket_rows`` rows
    each; a bucket's start is the running total of the counts before it, and rows are ranked within a
    bucket by ``order``. Only counts per key and bucket are ever ordered together.
    """
    keys, order = list(keys), list(order)
    n = df.count()
    buckets = max(1, -(-n // bucket_rows))
    # One text for the keys, nulls and all: window and join are then dealt alike, and rows are shuffled once.
    tagged = df.withColumn("__key", F.to_json(F.struct(*keys))).withColumn(
        "__bucket", F.pmod(F.xxhash64(*salt), F.lit(buckets)).cast("int")
    )
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy("__key", "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__key", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    rank = F.row_number().over(Window.partitionBy("__key", "__bucket").orderBy(*order)) - 1
    joined = tagged.withColumn("__rank", rank).join(starts, ["__key", "__bucket"])
    return joined.select(*df.columns, (F.col("__start") + F.col("__rank")).cast("long").alias(out))


def utf8_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def release() -> None:
    """Give memory that Arrow keeps for later back: a worker process waits for its next task with what it holds."""
    pa.default_memory_pool().release_unused()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
