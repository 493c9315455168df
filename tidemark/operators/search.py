"""Two searches over ordered rows that windows can't express, as joins: first contacts, and chains of successors.

Both cut the order into blocks of a fixed number of rows that become one row with an array, so that a look ahead costs a
few joins however far it goes, and no key's rows come together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import materialize

#: Rows of a block, and blocks of a block of the next level.
BLOCK = 64
#: Rows of a block of a chain.
LINKS = 512


def first_reach(rows: DataFrame, asks: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """``asks`` (keys, after, level, strict and others) with ``hit``: the first position after ``after`` that reaches ``level``.

    ``rows`` has keys, pos (whole, from 0 or 1, at most ``most``, which is found if not given) and value; null values reach
    nothing. A position reaches the level if its value is not less, or with ``strict`` if it is greater. Blocks of rows,
    blocks of blocks and so on, until one is left, tell where to look: the search climbs until a block must hold the
    position, and descends to it. A null ``after`` or ``level`` has no hit.
    """
    most = (rows.agg(F.max("pos")).first()[0] or 0) if most is None else most
    ordered = lambda at, value: F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))))
    tables, at, value, below = [], "pos", "value", rows.filter("value is not null")
    while True:
        level = below.groupBy(*keys, F.floor(F.col(at) / BLOCK).alias("block")).agg(ordered(at, value).alias("items"), F.max(value).alias("top"))
        tables.append(level)
        at, value, below = "block", "top", level
        most //= BLOCK
        if not most:
            break

    def look(found: DataFrame, k: int, block: Column, after: Column, out: str) -> DataFrame:
        reaches = lambda x: (x["v"] > F.col("level")) | (~F.col("strict") & (x["v"] == F.col("level")))
        known = tables[k].select(*keys, F.col("block").alias("__at"), F.col("items").alias("__items"))
        met = found.withColumn("__at", block).join(known, [*keys, "__at"], "left")
        return met.withColumn(out, F.get(F.filter("__items", lambda x: (x["at"] > after) & reaches(x)), F.lit(0))["at"]).drop("__at", "__items")

    found, got = asks, F.lit(False)
    for k in range(len(tables)):
        here = F.floor(F.col("after") / BLOCK**k)
        found = look(found, k, F.when(~got, F.floor(here / BLOCK)), here, f"__up{k}")
        got = got | F.col(f"__up{k}").isNotNull()
    found = found.withColumn("__down", F.lit(None).cast("long"))
    for k in range(len(tables) - 1, 0, -1):
        found = found.withColumn("__child", F.coalesce(f"__up{k}", "__down"))
        found = look(found, k - 1, F.col("__child"), F.lit(-1), "__down").drop("__child")
    return found.withColumn("hit", F.coalesce("__up0", "__down")).select(*asks.columns, "hit")


def chain(links: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (keys, idx) on the chain that starts at idx 1 of each key; ``links`` has keys, idx from 1, and next.

    ``next`` is a greater idx of the key, or null. Where a block is left follows for each of its rows from the rows
    behind it; entries of blocks are then found by doubling (a jump of jumps), and each entered block is walked by itself.
    """
    item = F.struct("idx", "next")
    blocks = links.groupBy(*keys, F.floor(F.col("idx") / LINKS).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    end = (F.col("block") + 1) * LINKS

    def leave(known: Column, x: Column) -> Column:
        inside = x["next"] < end
        to = F.when(inside, F.get(known, (x["next"] - x["idx"] - 1).cast("int"))["to"]).otherwise(x["next"])
        return F.concat(F.array(F.struct(x["idx"].alias("idx"), to.alias("to"))), known)

    empty = F.array().cast("array<struct<idx:bigint,to:bigint>>")
    jumps = blocks.select(*keys, F.explode(F.aggregate(F.reverse("items"), empty, leave)).alias("x")).select(*keys, "x.idx", "x.to")
    entries = links.filter("idx = 1").select(*keys, "idx")
    longest = (links.agg(F.max("idx")).first()[0] or 0) // LINKS
    if longest:
        jumps = materialize(jumps)
    for _ in range(longest.bit_length()):
        reached = entries.join(jumps, [*keys, "idx"]).filter("to is not null").select(*keys, F.col("to").alias("idx"))
        entries = materialize(entries.union(reached).distinct())
        far = jumps.select(*keys, F.col("idx").alias("to"), F.col("to").alias("beyond"))
        jumps = materialize(jumps.join(far, [*keys, "to"]).select(*keys, "idx", F.col("beyond").alias("to")))

    def walk(state: Column, x: Column) -> Column:
        on = x["idx"] == state["at"]
        seen = F.when(on, F.concat(state["seen"], F.array(x["idx"]))).otherwise(state["seen"])
        return F.struct(F.when(on, x["next"]).otherwise(state["at"]).alias("at"), seen.alias("seen"))

    entered = blocks.join(entries.withColumn("block", F.floor(F.col("idx") / LINKS)), [*keys, "block"])
    begin = F.struct(F.col("idx").alias("at"), F.array().cast("array<bigint>").alias("seen"))
    return entered.select(*keys, F.explode(F.aggregate("items", begin, walk)["seen"]).alias("idx"))
