"""Tables of results: groups with pooled totals, fixed domains, trade statistics, stocks, durations and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.measures import share
from tidemark.functions.scalars import DAY
from tidemark.operators import scan
from tidemark.operators.quantiles import described
from tidemark.sources.shared import materialize

TOTAL = "TOTAL"
#: Span of a block of running values, for orders in milliseconds with a few rows a day.
SPAN = 1024 * DAY


def flatten(df: DataFrame) -> DataFrame:
    """Measures (v, r) to columns ``name`` and ``name_reason``; other structs to ``name_field``."""

    def spread(column: Column, kind: T.DataType, name: str) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [column.alias(name)]
        if kind.names == ["v", "r"]:
            return [*spread(column["v"], kind["v"].dataType, name), column["r"].alias(f"{name}_reason")]
        return [c for f in kind.fields for c in spread(column[f.name], f.dataType, f"{name}_{f.name}")]

    return df.select(*[c for f in df.schema.fields for c in spread(F.col(f.name), f.dataType, f.name)])


def grouped(df: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """Description of a value for both keys, each key and all rows; TOTAL where a key is pooled.

    A row counts for each of the four sets that it belongs to.
    """
    a, b = by
    each = lambda x, y: F.struct(F.lit(x).alias("__a"), F.lit(y).alias("__b"))
    sets = F.explode(F.array(*[each(x, y) for x in (False, True) for y in (False, True)])).alias("__s")
    rows = df.select(a, b, value, sets).select("*", "__s.*")
    keys = {f"__{x}_key": F.when(~F.col(f"__{x}"), F.col(k)) for x, k in (("a", a), ("b", b))}
    rows = rows.select("__a", "__b", *[c.alias(n) for n, c in keys.items()], F.col(value).alias("__value"))
    names = ["__a", "__b", *keys]
    stats = described(rows, names, F.col("__value"), quantiles)
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    same = [counts[n].eqNullSafe(stats[n]) for n in names]
    met = counts.join(stats, same).select(*[counts[c] for c in counts.columns], *[stats[c] for c in stats.columns if c not in names])
    out = [F.when(F.col(f"__{x}"), TOTAL).otherwise(F.col(f"__{x}_key")).alias(k) for x, k in (("a", a), ("b", b))]
    return met.select(*out, "rows", "n", *[F.round(c, 6).alias(c) for c in stats.columns if c not in (*names, "n")])


def filled_counts(df: DataFrame, period: str, state: str, domain: list[str], value: str) -> DataFrame:
    """Counts and sums of each period and declared state, empty cells included, with totals of each state."""
    counts = df.groupingSets([[period, state], [state]], period, state).agg(
        F.grouping(period).alias("__p"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )
    counts = counts.select(F.when(F.col("__p") == 1, TOTAL).otherwise(F.col(period)).alias(period), state, "n", "total")
    states = F.explode(F.array(*[F.lit(s) for s in domain])).alias(state)
    periods = df.select(period).distinct().unionByName(df.sparkSession.createDataFrame([(TOTAL,)], f"{period} string"))
    filled = periods.select(period, states).join(counts, [period, state], "left")
    return filled.select(period, state, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


def first_of_each(df: DataFrame, categories: dict[str, str], order: list[str]) -> DataFrame:
    """The first row of each category by an order, null where there is none; one row may stand for several."""
    hit = F.filter(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in categories.items()]), lambda x: x.isNotNull())
    found = df.select(F.explode(hit).alias("category"), F.struct(*order).alias("k")).groupBy("category").agg(F.min("k").alias("k"))
    domain = df.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return domain.join(found, "category", "left").select("category", *[F.col(f"k.{o}").alias(o) for o in order])


def trade_stats(df: DataFrame, by: list[str], net: str) -> DataFrame:
    """Counts, sums, payoff and profit factor of results; null where there is no loss or gain to divide by."""
    x = F.col(net)
    gain, loss = F.when(x > 0, x), F.when(x < 0, -x)
    rows = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(gain).alias("wins"), F.count(loss).alias("losses"),
        F.sum(x).alias("net"), F.sum(gain).alias("gains"), F.sum(loss).alias("lost"), F.max(x).alias("best"), F.min(x).alias("worst"),
    )
    payoff = share(F.col("gains") / F.col("wins"), F.col("lost") / F.col("losses"))
    return rows.select(
        *by, "n", "wins", "losses", F.round("net", 2).alias("net"), F.round("best", 4).alias("best"), F.round("worst", 4).alias("worst"),
        F.round(share(F.col("wins"), F.col("n")), 6).alias("positive_share"), F.round(payoff, 6).alias("payoff"),
        F.round(share(F.col("gains"), F.col("lost")), 6).alias("profit_factor"),
    )


def drawdown_path(df: DataFrame, by: list[str], order: str, net: str, span: int = SPAN) -> DataFrame:
    """Running result (null from the first unknown one on), its peak from zero, and the distance to it.

    ``df`` is written once. Sums and peaks run over blocks of ``span`` of the order.
    """
    block = scan.block_of(order, span)
    runs = {"__unknown": scan.greatest(F.col(net).isNull()), "__sum": scan.total(F.col(net))}
    path = scan.running(materialize(df), by, [order], block, runs).withColumn("equity", F.when(~F.col("__unknown"), F.col("__sum")))
    path = scan.running(path.drop("__unknown", "__sum"), by, [order], block, {"__peak": scan.greatest(F.col("equity"))})
    path = path.withColumn("peak", F.greatest(F.lit(0.0), "__peak")).drop("__peak")
    return path.withColumn("below", F.col("equity") - F.col("peak"))


def drawdown(df: DataFrame, by: list[str], order: str, net: str, base: float = 1000.0, span: int = SPAN) -> DataFrame:
    """Largest fall from a peak, in units and in parts per ten thousand of ``base``; null if a result is unknown."""
    path = drawdown_path(df, by, order, net, span)
    missing = F.count_if(F.col("equity").isNull()) > 0
    worst = F.when(~missing, F.least(F.lit(0.0), F.min("below")))
    return path.groupBy(*by).agg(
        F.round(worst, 4).alias("max_drawdown"), F.round(worst / base * 10_000, 4).alias("max_drawdown_bps"),
        F.round(F.max_by("equity", order), 4).alias("end"), F.count(F.lit(1)).alias("points"),
    )


def losing_streak(df: DataFrame, by: list[str], order: str, net: str, span: int = SPAN) -> DataFrame:
    """Longest run of losses: runs are islands between results that are no loss."""
    df = materialize(df)
    other = F.when(~(F.col(net) < 0), 1).otherwise(0)
    rows = scan.running(df, by, [order], scan.block_of(order, span), {"__i": scan.total(other)})
    runs = rows.filter(F.col(net) < 0).groupBy(*by, "__i").agg(F.count(F.lit(1)).alias("run"))
    longest = runs.groupBy(*by).agg(F.max("run").alias("run"))
    return df.select(*by).distinct().join(longest, by, "left").select(*by, F.coalesce("run", F.lit(0)).alias("longest"))


def concentration(df: DataFrame, by: list[str], net: str, key: str, k: int) -> DataFrame:
    """Share of the ``k`` largest results in the sum of absolute ones; ties by ``key``. Only ``k`` a group are kept."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.abs(net)), key)
    top = df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k)
    top = top.groupBy(*by).agg(F.sum(F.abs(net)).alias("top"))
    whole = df.groupBy(*by).agg(F.sum(F.abs(net)).alias("all"), F.count(F.lit(1)).alias("n"))
    return whole.join(top, by).select(*by, F.round(share(F.col("top"), F.col("all")), 6).alias("top_share"), "n")


def stock_flow(spans: DataFrame, by: list[str], low: str, high: str, width: int) -> DataFrame:
    """Births, ends and stocks of each period (lo, hi]; a period's end is the next one's start."""
    period = lambda c: (F.ceil(F.col(c) / width) * width).alias("period_end")
    births = spans.select(*by, period(low), F.lit(1).alias("born"), F.lit(0).alias("ended"))
    ends = spans.select(*by, period(high), F.lit(0).alias("born"), F.lit(1).alias("ended"))
    moves = births.unionByName(ends).groupBy(*by, "period_end").agg(F.sum("born").alias("births"), F.sum("ended").alias("ends"))
    running = Window.partitionBy(*by).orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    stock = F.sum(F.col("births") - F.col("ends")).over(running)
    return moves.withColumn("stock_end", stock).select(
        *by, "period_end", (F.col("stock_end") - F.col("births") + F.col("ends")).alias("stock_start"), "births", "ends", "stock_end"
    )


def durations(df: DataFrame, by: list[str], born: str, reached: str, unit: int) -> DataFrame:
    """Durations that were reached, and those still running at the end of the data, apart."""
    last = df.agg(F.max(F.greatest(F.col(born), F.coalesce(reached, F.col(born)))).alias("m")).first()["m"]
    kind = F.when(F.col(reached).isNotNull(), "AVAILABLE").otherwise("CENSORED")
    value = (F.coalesce(F.col(reached), F.lit(last)) - F.col(born)) / unit
    rows = df.select(*by, kind.alias("kind"), value.alias("value"))
    found = described(rows, [*by, "kind"], F.col("value"), (0.5, 0.9))
    return found.select(*by, "kind", "n", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "p50", "p90")])


def register_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys gone, added or changed, and how many of each field changed."""
    b, a = before.alias("b"), after.alias("a")
    met = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"), "full_outer")
    differs = [~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")) for f in fields]
    both = F.col(f"b.{key}").isNotNull() & F.col(f"a.{key}").isNotNull()
    any_differs = differs[0]
    for d in differs[1:]:
        any_differs = any_differs | d
    state = F.when(F.col(f"a.{key}").isNull(), "GONE").when(F.col(f"b.{key}").isNull(), "ADDED").when(any_differs, "CHANGED").otherwise("SAME")
    return met.groupBy(state.alias("state")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(both & d).alias(f"{f}_changed") for f, d in zip(fields, differs, strict=True)]
    )


def differing_totals(cells: DataFrame, totals: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, expected, found) where the cells of a group do not sum to its total, or one of the two is missing."""
    summed = cells.groupBy(*keys).agg(F.sum(n).alias("found"))
    met = totals.select(*keys, F.col(n).alias("expected")).join(summed, keys, "full_outer")
    return met.filter(~F.col("expected").eqNullSafe(F.col("found")))


def funnel(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, n): how many rows each step has, in order of the steps."""
    counted = [df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("place"), F.lit(name).alias("step"), "n") for i, (name, df) in enumerate(steps)]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out
