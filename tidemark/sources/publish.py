"""Results as datasets: written whole, described by a manifest that comes last, and listed by a catalogue.

A run's folder is named by the identity of its configuration and inputs, so a rerun finds its own result. Readers go
by manifests only: a folder without one is a run that did not finish.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import canonical_json, identity
from tidemark.operators.asof import interval_join
from tidemark.operators.summary import flatten

SCHEMA_VERSION = 1


def columnar(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Rows of each key as arrays in order, one array for each column; keys must be small."""
    rest = [c for c in rows.columns if c != by]
    packed = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("x"))
    return packed.select(by, *[F.col(f"x.{name}").alias(name) for name in rest])


def content_hash(df: DataFrame) -> str:
    """A digest of the rows that does not depend on their order or on partitions."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    found = df.select(row.cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{found['n']}:{found['s'] or 0}"


def publish(results: dict[str, DataFrame], base: str, config: dict[str, Any], inputs: dict[str, str]) -> str:
    """Write each result as Parquet below ``base``/run id, then the manifest. Returns the run id.

    A run that has a manifest is finished and is left as it is, so that nobody reads half of another under it. What is
    written without one is nobody's yet. A copy of the manifest keeps the time of the run in its name.
    """
    spark = next(iter(results.values())).sparkSession
    run = identity({"config": config, "inputs": inputs})[:16]
    if not catalogue(spark, base).filter(F.col("run") == run).isEmpty():
        return run
    datasets = {}
    for name, df in results.items():
        path = f"{base}/{run}/{name}"
        df.write.mode("overwrite").parquet(path)
        back = spark.read.parquet(path)
        datasets[name] = {"path": name, "rows": back.count(), "hash": content_hash(back), "schema": back.schema.simpleString()}
    manifest = {"schema": SCHEMA_VERSION, "run": run, "config": config, "inputs": inputs, "datasets": datasets}
    text = canonical_json(manifest).decode()
    stated = spark.createDataFrame([(text,)], "value string").coalesce(1)
    stated.write.mode("overwrite").text(f"{base}/{run}/history/{datetime.now(UTC):%Y%m%dT%H%M%SZ}")
    stated.write.mode("overwrite").text(f"{base}/{run}/manifest")
    return run


def catalogue(spark: SparkSession, base: str) -> DataFrame:
    """(run, dataset, rows, hash) of every finished run; none where nothing has been published."""
    try:
        manifests = spark.read.text(f"{base}/*/manifest")
    except AnalysisException:  # there is no such path
        manifests = spark.createDataFrame([], "value string")
    kind = "run string, schema int, datasets map<string, struct<rows:bigint,hash:string>>"
    rows = manifests.select(F.from_json("value", kind).alias("m")).filter(F.col("m.schema") == SCHEMA_VERSION)
    return rows.select("m.run", F.explode("m.datasets").alias("dataset", "d")).select("run", "dataset", "d.rows", "d.hash")


def open_result(spark: SparkSession, base: str, run: str, name: str) -> DataFrame:
    """A dataset of a run, only if it is what its manifest says."""
    manifest = json.loads(spark.read.text(f"{base}/{run}/manifest").first()[0])
    stated = manifest["datasets"][name]
    found = spark.read.parquet(f"{base}/{run}/{name}")
    if found.schema.simpleString() != stated["schema"] or content_hash(found) != stated["hash"]:
        raise ValueError(f"{run}/{name} differs from its manifest")
    return found


def write_csv(df: DataFrame, path: str) -> None:
    """Flat CSV with a header: measures become a value and a reason column."""
    flatten(df).write.mode("overwrite").option("header", True).csv(path)


def case_windows(cases: DataFrame, bars: DataFrame, by: list[str], at: str, before: int, after: int) -> DataFrame:
    """The bars around each case, in order, known before its time and after apart; computed bars are cut, not recomputed."""
    spans = cases.select(*by, "case_id", F.col(at).alias("__at"), (F.col(at) - before + 1).alias("__lo"), (F.col(at) + after).alias("__hi"))
    met = interval_join(bars.select(*by, "t1", "o", "h", "l", "c"), spans, by, "t1", "__lo", "__hi", before + after)
    bar = F.struct("t1", "o", "h", "l", "c")
    return met.groupBy(*by, "case_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("t1") <= F.col("__at"), bar))).alias("known"),
        F.sort_array(F.collect_list(F.when(F.col("t1") > F.col("__at"), bar))).alias("later"),
    )


def markdown(rows: DataFrame) -> str:
    """A small result as a table, all its rows."""
    lines = [" | ".join(rows.columns), " | ".join("---" for _ in rows.columns)]
    shown = (" | ".join("" if v is None else f"{v:,.4g}" if isinstance(v, float) else str(v) for v in r) for r in rows.toLocalIterator())
    return "\n".join(f"| {x} |" for x in [*lines, *shown])
