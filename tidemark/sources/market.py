"""Market files: minute and funding rows from CSV, plain or zipped, validated and with nothing dropped silently.

Files are whole (a month each), so a file is read in one task as numbered lines and everything after is columns.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import MINUTE, month_bounds, months_between

# Columns of the minute and funding files, and the time from which a number cannot be milliseconds.
MINUTE_COLUMNS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume",
    "taker_buy_quote_volume", "ignore",
)
FUNDING_COLUMNS = ("calc_time", "funding_interval_hours", "last_funding_rate")
NOT_MILLISECONDS = 10**13
VALID, INVALID, MISSING = "VALID", "INVALID", "MISSING"
VALUES = ("o", "h", "l", "c", "v", "q", "n", "tb", "tq")


class SchemaError(ValueError):
    """A file that is not what its name says."""


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line_no, line) of CSV files; a zip must hold one CSV member of its own name."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rpartition("/")[2]
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        if z.namelist() != [name.removesuffix(".zip") + ".csv"]:
                            raise SchemaError(f"{name}: members {z.namelist()}")
                        content = z.read(z.namelist()[0])
                rows = content.decode("utf-8-sig").splitlines()
                numbers = pa.array(range(1, len(rows) + 1), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), numbers, pa.array(rows, pa.string())], ["file", "line_no", "line"])

    return files.mapInArrow(lines, "file string, line_no long, line string").filter(F.trim("line") != "")


def write_lines(lines: DataFrame, folder: str) -> DataFrame:
    """Write (file, line_no, line) as one CSV file for each name below ``folder``; (path, lines) of what was written.

    A file is a month of a series, so it is written whole by the task that has it.
    """

    def write(group: pa.Table) -> pa.Table:
        fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(path, recursive=True)
        ordered = group.sort_by("line_no")
        name = ordered.column("file")[0].as_py()
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write("".join(f"{x}\n" for x in ordered.column("line").to_pylist()).encode())
        return pa.table({"path": [f"{folder}/{name}"], "lines": pa.array([group.num_rows], pa.int64())})

    return lines.select("file", "line_no", "line").groupBy("file").applyInArrow(write, "path string, lines long")


def _is_header(columns: tuple[str, ...]) -> Column:
    """True for a header line; a first line that is neither header nor data fails the run."""
    first = (F.col("line_no") == 1) & ~F.get(F.split("line", ","), 0).rlike(r"^\s*-?\d+\s*$")
    same = F.regexp_replace("line", r"\s", "") == ",".join(columns)
    bad = F.raise_error(F.concat(F.lit("unknown header in "), F.col("file"), F.lit(": "), F.col("line"))).cast("boolean")
    return F.when(first & ~same, bad).otherwise(first)


def minute_rows(lines: DataFrame, positive: bool = True) -> DataFrame:
    """Parsed rows with ``problem``: the first thing wrong with a row, or null.

    FIELD_COUNT, TIME_NOT_INTEGER and TIME_NOT_MINUTE_ALIGNED rows touch no minute; VALUE_NOT_NUMERIC and rows whose
    values contradict each other do. Times that cannot be milliseconds fail the run. Without ``positive`` the four
    prices are any numbers, and an empty one is an unknown price and no fault.
    """
    parts = F.split("line", ",")
    rows = lines.filter(~_is_header(MINUTE_COLUMNS)).select("file", "line_no", parts.alias("f"))
    number = lambda i: F.expr(f"try_cast(trim(get(f, {i})) as double)")
    whole = lambda i: F.expr(f"try_cast(trim(get(f, {i})) as bigint)")
    rows = rows.select(
        "file", "line_no", F.size("f").alias("fields"), whole(0).alias("t"), whole(6).alias("t_close"),
        *[number(i).alias(c) for i, c in ((1, "o"), (2, "h"), (3, "l"), (4, "c"), (5, "v"), (7, "q"), (9, "tb"), (10, "tq"))],
        whole(8).alias("n"), F.array(*[F.trim(F.get("f", i)) == "" for i in (1, 2, 3, 4)]).alias("empty"),
    )
    unit = F.raise_error(F.concat(F.lit("not milliseconds in "), F.col("file"))).cast("string")
    prices = [F.col(c) for c in ("o", "h", "l", "c")]
    amounts = [F.col(c) for c in ("v", "q", "tb", "tq")]
    unknown = F.col("n").isNull()
    for c in amounts:
        unknown = unknown | c.isNull()
    finite = F.lit(True)
    for i, c in enumerate(prices):
        unknown = unknown | (c.isNull() if positive else c.isNull() & ~F.get("empty", i))
        finite = finite & (c > 0) & (c < float("inf")) if positive else finite
    calm = F.col("n") >= 0
    for c in amounts:
        calm = calm & (c >= 0) & (c < float("inf"))
    ordered = (F.col("h") >= F.greatest("o", "c", "l")) & (F.col("l") <= F.least("o", "c", "h"))
    problem = (
        F.when(F.col("fields") != len(MINUTE_COLUMNS), "FIELD_COUNT")
        .when(F.col("t").isNull() | F.col("t_close").isNull(), "TIME_NOT_INTEGER")
        .when((F.col("t") >= NOT_MILLISECONDS) | (F.col("t_close") >= NOT_MILLISECONDS), unit)
        .when((F.pmod("t", F.lit(MINUTE)) != 0) | (F.col("t_close") != F.col("t") + MINUTE - 1), "TIME_NOT_MINUTE_ALIGNED")
        .when(unknown, "VALUE_NOT_NUMERIC")
        .when(~finite, "PRICE_NOT_POSITIVE")
        .when(~ordered, "PRICES_INCONSISTENT")
        .when(~calm, "AMOUNT_NEGATIVE")
    )
    return rows.withColumn("problem", problem).drop("empty")


def in_month(rows: DataFrame, reach: tuple[int, int] | None = None) -> DataFrame:
    """Mark rows outside the month that the file's name ends with, or outside [lo, hi) of ``reach`` where files have more months."""
    month = F.to_date(F.concat(F.regexp_extract("file", r"(\d{4}-\d{2})\.(?:csv|zip)$", 1), F.lit("-01")))
    lo = F.unix_date(month).cast("long") * 86_400_000
    hi = F.unix_date(F.add_months(month, 1)).cast("long") * 86_400_000
    if reach:
        lo, hi = map(F.lit, reach)
    outside = F.col("t").isNotNull() & month.isNotNull() & ~((F.col("t") >= lo) & (F.col("t") < hi))
    return rows.withColumn("problem", F.when(F.col("problem").isin("FIELD_COUNT", "TIME_NOT_INTEGER", "TIME_NOT_MINUTE_ALIGNED"), F.col("problem")).when(outside, "OUTSIDE_FILE_MONTH").otherwise(F.col("problem")))


def out_of_order(rows: DataFrame) -> DataFrame:
    """Rows at or before a time that an earlier line of the file had."""
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.filter("t is not null").withColumn("late", F.coalesce(F.col("t") <= F.max("t").over(before), F.lit(False)))


def minutes(rows: DataFrame) -> DataFrame:
    """One row for each minute that a row touches: VALID with values, or INVALID.

    Rows that say the same are one. Rows that differ, or one with impossible values, make the minute invalid for good;
    a row that is not numeric only until a later valid one.
    """
    touching = rows.filter(F.col("t").isNotNull() & (F.col("problem").isNull() | F.col("problem").isin("VALUE_NOT_NUMERIC", "PRICE_NOT_POSITIVE", "PRICES_INCONSISTENT", "AMOUNT_NEGATIVE")))
    good = F.col("problem").isNull()
    values = F.struct(*VALUES)
    found = touching.groupBy("file", "t").agg(
        F.min(F.when(good, values)).alias("x"),
        F.max(F.when(good, values)).alias("y"),
        F.count_if(good).alias("good_rows"),
        F.count_if(~good & (F.col("problem") != "VALUE_NOT_NUMERIC")).alias("poison"),
        F.max(F.when(good, F.col("line_no"))).alias("last_good"),
        F.max(F.when(F.col("problem") == "VALUE_NOT_NUMERIC", F.col("line_no"))).alias("last_text"),
        F.min(F.when(good, F.col("line_no"))).alias("first_good"),
    )
    # A valid row that repeats one before a text row does not set the minute again.
    cleared = F.col("last_text").isNull() | (F.col("first_good") > F.col("last_text"))
    valid = (F.col("good_rows") > 0) & (F.col("poison") == 0) & (F.col("x") == F.col("y")) & cleared
    return found.select(
        "file", "t", F.when(valid, VALID).otherwise(INVALID).alias("status"), *[F.when(valid, F.col(f"x.{c}")).alias(c) for c in VALUES],
        (F.col("good_rows") - 1).alias("repeats"), (F.col("x") != F.col("y")).alias("discordant"),
    )


def minute_grid(found: DataFrame, lo: int, hi: int) -> DataFrame:
    """Every minute of [lo, hi): VALID, INVALID or MISSING."""
    grid = found.sparkSession.range(lo // MINUTE, hi // MINUTE).select((F.col("id") * MINUTE).alias("t"))
    return grid.join(found.drop("file"), "t", "left").withColumn("status", F.coalesce("status", F.lit(MISSING)))


def coverage_grid(found: DataFrame, lo: int, hi: int) -> DataFrame:
    """Every minute of [lo, hi) for every file: (file, t, status)."""
    files = found.select("file").distinct()
    grid = files.select("file", F.explode(F.sequence(F.lit(lo), F.lit(hi - MINUTE), F.lit(MINUTE))).alias("t"))
    return grid.join(found.select("file", "t", "status"), ["file", "t"], "left").withColumn("status", F.coalesce("status", F.lit(MISSING)))


def funding_rows(lines: DataFrame) -> DataFrame:
    """Funding rows with ``problem``."""
    rows = lines.filter(~_is_header(FUNDING_COLUMNS)).select("file", "line_no", F.split("line", ",").alias("f"))
    rows = rows.select(
        "file", "line_no", F.expr("try_cast(trim(get(f, 0)) as bigint)").alias("tau"), F.expr("try_cast(trim(get(f, 1)) as double)").alias("hours"),
        F.expr("try_cast(trim(get(f, 2)) as double)").alias("rate"),
    )
    known = F.col("tau").isNotNull() & F.col("hours").isNotNull() & F.col("rate").isNotNull()
    finite = (F.col("hours") > 0) & (F.col("hours") < float("inf")) & ~F.isnan("rate") & (F.abs("rate") < float("inf"))
    unit = F.raise_error(F.concat(F.lit("not milliseconds in "), F.col("file"))).cast("string")
    return rows.withColumn("problem", F.when(~known, "ROW_NOT_PARSABLE").when(F.col("tau") >= NOT_MILLISECONDS, unit).when(~finite, "VALUE_NOT_FINITE"))


def funding_anomalies(rows: DataFrame, lo: int, hi: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, kind, tau, count) of everything that keeps a funding series from being certified for [lo, hi).

    ``by`` names the columns that tell series apart; without it all rows are one series.
    """
    good, keys = rows.filter("problem is null"), list(by)
    corrupt = rows.filter("problem is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter("count > 0")
    each = good.groupBy(*keys, "tau").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("rate", "hours").alias("kinds"), F.min("hours").alias("hours"))
    repeated = each.filter("count > 1").select(*keys, F.when(F.col("kinds") > 1, "CONFLICTING_DUPLICATE").otherwise("DUPLICATE_TIMESTAMP").alias("kind"), "tau", "count")
    order = Window.partitionBy(*keys).orderBy("tau")  # a series has a few rates a day
    gaps = each.withColumn("next", F.lead("tau").over(order)).filter(F.abs(F.col("next") - F.col("tau") - F.col("hours") * 3_600_000) > MINUTE)
    ends = each.groupBy(*keys).agg(F.min(F.struct("tau", "hours")).alias("a"), F.max(F.struct("tau", "hours")).alias("z"), F.count(F.lit(1)).alias("n"))
    if keys:  # a series that has no good row is there as well
        named = rows.select(*keys).distinct()
        same = [named[k].eqNullSafe(ends[k]) for k in keys]
        ends = named.join(ends, same, "left").select(*[named[k] for k in keys], "a", "z", F.coalesce("n", F.lit(0)).alias("n"))
    slack = lambda e: F.col(f"{e}.hours") * 3_600_000 + MINUTE
    edges = F.array(
        F.when(F.col("n") == 0, F.struct(F.lit("EMPTY").alias("kind"), F.lit(None).cast("long").alias("tau"))),
        F.when(F.col("a.tau") - lo > slack("a"), F.struct(F.lit("START_COVERAGE").alias("kind"), F.col("a.tau").alias("tau"))),
        F.when(hi - F.col("z.tau") > slack("z"), F.struct(F.lit("END_COVERAGE").alias("kind"), F.col("z.tau").alias("tau"))),
    )
    one = F.lit(1).cast("long").alias("count")
    edge = ends.select(*keys, F.explode(F.filter(edges, lambda x: x.isNotNull())).alias("e")).select(*keys, "e.kind", "e.tau", one)
    return (
        corrupt.select(*keys, F.lit("CORRUPT_ROWS").alias("kind"), F.lit(None).cast("long").alias("tau"), "count")
        .unionByName(repeated)
        .unionByName(gaps.select(*keys, F.lit("INTERVAL_MISMATCH").alias("kind"), "tau", one))
        .unionByName(edge)
    )


def require_empty(problems: DataFrame, what: str) -> None:
    """Fail with the first problems; none is dropped without a word."""
    if rows := problems.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def parse_checksum(text: str, name: str) -> str:
    """Digest of a checksum file that must name exactly this file."""
    parts = text.split()
    if len(parts) != 2 or parts[1].lstrip("*") != name or len(parts[0]) != 64:
        raise SchemaError(f"checksum of {name}: {text!r}")
    return parts[0].lower()


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, sha256) of whole files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def unverified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest files that are missing or differ."""
    met = manifest.join(found.withColumnRenamed("sha256", "found"), "file", "left")
    return met.filter(~F.col("found").eqNullSafe(F.col("sha256"))).select("file", "sha256", "found")


def month_paths(folder: str, symbol: str, lo: int, hi: int, suffix: str = "zip") -> list[str]:
    """The monthly files that [lo, hi) needs, and no other: partition pruning by name."""
    return [f"{folder}/{symbol}-{m}.{suffix}" for m in months_between(lo, hi)]


def missing_months(have: list[str], lo: int, hi: int) -> list[str]:
    return [m for m in months_between(lo, hi) if m not in have]


def place(source: str, target: str, sha256: str) -> bool:
    """Copy a file into the data folder if it has the digest; whole or not at all. False if it was there."""
    to = Path(target)
    if to.exists() and hashlib.sha256(to.read_bytes()).hexdigest() == sha256:
        return False
    data = Path(source).read_bytes()
    if hashlib.sha256(data).hexdigest() != sha256:
        raise SchemaError(f"{source} does not have the digest that its checksum states")
    part = to.with_name(to.name + ".part")
    part.write_bytes(data)
    part.replace(to)
    return True


def synthetic_minutes(spark: SparkSession, month: str, seed: int, start: float = 100.0) -> DataFrame:
    """A seeded random walk of minutes: cumulative sums over hash-made steps, the same wherever it runs."""
    lo, hi = month_bounds(month)
    unit = lambda k: F.pmod(F.xxhash64("t", F.lit(seed + k)), F.lit(1 << 20)) / (1 << 20)
    rows = spark.range(lo // MINUTE, hi // MINUTE).select((F.col("id") * MINUTE).alias("t"))
    rows = rows.withColumn("step", unit(0) - 0.5).withColumn("day", F.floor(F.col("t") / 86_400_000))
    # Sums of days first, then within days, so no task holds the walk.
    days = rows.groupBy("day").agg(F.sum("step").alias("total"))
    before = days.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    within = Window.partitionBy("day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    walk = rows.join(F.broadcast(before.select("day", "base")), "day").withColumn("x", F.col("base") + F.sum("step").over(within))
    c = start * F.exp(F.col("x") / 200)
    o = start * F.exp((F.col("x") - F.col("step")) / 200)
    return walk.select(
        "t", o.alias("o"), (F.greatest(o, c) * (1 + unit(1) / 1000)).alias("h"), (F.least(o, c) * (1 - unit(2) / 1000)).alias("l"), c.alias("c"), (1 + unit(3) * 10).alias("v")
    )
