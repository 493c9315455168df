"""Registry of the time-series queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import MINUTE
from tidemark.operators import bars, observe
from tidemark.plans import ingest, live, minutes, oracle
from tidemark.plans import queries as plans

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hour bars of all ticks with indicators, structure and anchors, one row for each bar."""
    names = ("o", "h", "l", "c", "a", "sma_fast", "dist", "u")
    seen = observe.observe(bars.aggregate(plans.ticks(spark, sf_dir, F.lit("ALL")), 180 * MINUTE))
    return seen.select("series", "t0", "t1", "status", "segment", "pos", *plans.r6(*names), "structure", "cross", "version")


def queries() -> dict[str, Query]:
    return plans.ALL | ingest.ALL | live.ALL | minutes.ALL


def oracle_sql() -> dict[str, str]:
    return oracle.ALL | ingest.ORACLE | live.ORACLE | minutes.ORACLE
