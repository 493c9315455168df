"""Constraints as queries: each returns what breaks it, and nothing where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import COMPLETE, INCOMPLETE


def broken(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for each row and rule that does not hold; an unknown condition does not hold."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(failed).alias("rule"))


def bar_violations(bars: DataFrame) -> DataFrame:
    """Bars off the grid, out of the enumeration, with prices that contradict each other or that should not be there."""
    by_time = Window.partitionBy("series").orderBy("t0")
    rows = bars.withColumn("__before", F.lag("t1").over(by_time))
    complete, none = F.col("status") == COMPLETE, F.coalesce("o", "h", "l", "c").isNull()
    ordered = (F.col("h") >= F.greatest("o", "c")) & (F.col("l") <= F.least("o", "c")) & (F.col("ticks") > 0)
    return broken(
        rows,
        ["series", "t0"],
        {
            "status": F.col("status").isin(COMPLETE, INCOMPLETE),
            "width": F.col("t1") > F.col("t0"),
            "grid": F.col("__before").isNull() | (F.col("__before") == F.col("t0")),
            "prices": F.when(complete, ordered).otherwise(none),
        },
    )


def observation_violations(observed: DataFrame, measures: list[str]) -> DataFrame:
    """Measures that have both a value and a reason, or neither; pivots known before their candidate ended."""
    rules = {m: F.col(m).isNull() != F.col(f"{m}_r").isNull() for m in measures}
    rules["pivot time"] = F.col("pivot_kind").isNull() | (F.col("candidate_t1") < F.col("t1"))
    rules["segment"] = (F.col("segment").isNull()) == (F.col("status") != COMPLETE)
    return broken(observed, ["series", "t0"], rules)


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of two ways to the same figures that differ, or that only one of them has."""
    x, y = a.select(*keys, *[F.col(n).alias(f"a_{n}") for n in names]), b.select(*keys, *[F.col(n).alias(f"b_{n}") for n in names])
    met = x.withColumn("__a", F.lit(1)).join(y.withColumn("__b", F.lit(1)), keys, "full_outer")
    rules = {n: (F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")) <= tolerance) | (F.col(f"a_{n}").isNull() & F.col(f"b_{n}").isNull()) for n in names}
    rules["on both sides"] = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return broken(met, keys, rules)


def unchanged(before: DataFrame, after: DataFrame, but: list[str]) -> DataFrame:
    """Rows in which a new projection differs from the one it replaces, outside the columns that were to change."""
    kept = [c for c in before.columns if c not in but]
    a, b = before.select(*kept), after.select(*kept)
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))
