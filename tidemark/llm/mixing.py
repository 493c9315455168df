"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. Time is in slots of one block. With target weight w, block j of a source is
released at slot floor(j / w) and due by slot ceil((j + 1) / w); of the released blocks the one with the earliest
deadline takes the slot, ties by source. A source's blocks so far then differ from w times the slots so far by less
than one block at any slot. Weights are whole parts of ``PARTS``, so releases and deadlines are exact integers.

The schedule is not one fold. Time is cut into frames of ``FRAME`` slots, and each frame is scheduled by itself, in
parallel: what every source has had at a frame's two ends follows from the weights alone (the whole part of w t, and
one more for the largest remainders, so that all sum to t). A source with a block in every frame (w of 1 / ``FRAME`` or
more) is a member of the schedule; there are at most ``FRAME`` of them. All lighter sources are one member together, the
pool, and their blocks take the pool's slots by the middle of their windows. So a frame holds ``FRAME`` slots and at most as many members,
however many sources and rows there are, and sources never meet in one row.

When a source has no blocks left, its slots stay empty and the others keep their proportions. Slots are unique to a
block and increase in reading order, but may have gaps at the end.

Only DataFrame functions are used. Rows are numbered within a source by hash buckets, so a source that has most rows
is spread over as many tasks as its rows need. Slots meet rows in an equi-join on source and block; Spark broadcasts the
slots only where it finds them small.

Defined results: a null source is a source of its own; repeated rows are each placed; null doc_ids are placed; empty,
null and very long texts count one row like any other (texts are not read); a weight that is null, negative or zero is
the least weight; an empty table gives an empty result; the operator's columns are named with their purpose, and
``mixed`` returns the input's columns only, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dense_index, materialize, partitions

#: Rows of a block.
BLOCK_ROWS = 64
#: Slots of a frame, and the most sources that are scheduled one by one.
FRAME = 1024
#: Whole parts that the weights are rounded to.
PARTS = 1 << 31
#: Default target weights are the sources' row counts to this power, scaled to one.
TEMPERATURE = 0.5
#: Rows that one bucket of the numbering has, about.
BUCKET_ROWS = 4000


def _ceil_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a + b - 1, b)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _had(parts: Column, t: Column, total: int) -> Column:
    """Blocks that each member has had by slot ``t``: whole shares, and one more for the largest remainders."""
    whole = F.transform(parts, lambda p: _div(p * t, F.lit(total)))
    left = F.transform(parts, lambda p, i: F.struct((-((p * t) % F.lit(total))).alias("r"), i.alias("i")))

    def raised(x: Column) -> Column:
        more = (t - F.aggregate(x["whole"], F.lit(0).cast("long"), lambda a, w: a + w)).cast("int")
        last = F.when(more > 0, F.get(F.array_sort(x["left"]), more - 1))
        one = lambda y: F.zip_with(x["whole"], x["left"], lambda w, r: w + F.coalesce(r <= y, F.lit(False)).cast("long"))
        return _bound(last, one)

    return _bound(F.struct(whole.alias("whole"), left.alias("left")), raised)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _frame_order(parts: Column, start: Column, frame: int, total: int) -> Column:
    """The blocks (i: member, j: block) of a frame, one for each slot, by earliest deadline."""

    def due(known: Column, given: Column, slot: Column):
        def one(p: Column, i: Column) -> Column:
            j = F.get(given, i)
            release = _div(j * total, p)
            early = release > slot
            return F.struct(
                (j >= F.get(known["end"], i)).alias("none"),
                early.alias("early"),
                F.when(early, release).otherwise(_ceil_div((j + 1) * total, p)).alias("due"),
                i.alias("i"),
                j.alias("j"),
            )

        return one

    def fold(known: Column) -> Column:
        def step(state: Column, slot: Column) -> Column:
            def take(taken: Column) -> Column:
                given = F.transform(state["given"], lambda x, i: x + (i == taken["i"]).cast("long"))
                block = F.struct(taken["i"].alias("i"), taken["j"].alias("j"))
                return F.struct(given.alias("given"), F.concat(state["order"], F.array(block)).alias("order"))

            return _bound(F.array_min(F.transform(known["parts"], due(known, state["given"], slot))), take)

        begin = F.struct(known["begin"].alias("given"), F.array().cast("array<struct<i:int,j:bigint>>").alias("order"))
        slots = F.sequence(known["start"], known["start"] + F.lit(frame - 1))
        return F.aggregate(slots, begin, step, lambda state: state["order"])

    def ends(p: Column) -> Column:
        at = lambda t: _had(p, t, total)
        return _bound(F.struct(p.alias("parts"), start.alias("start"), at(start).alias("begin"), at(start + frame).alias("end")), fold)

    return _bound(parts, ends)


def whole_parts(weights: DataFrame) -> DataFrame:
    """(source, part): weights as whole parts of about ``PARTS``, one at least; a source named twice has its first."""
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    single = weights.groupBy("source").agg(F.max(weight).alias("weight"))
    sums = single.agg(F.sum("weight").alias("sum"))
    part = F.round(F.col("weight") / F.col("sum") * PARTS).cast("long")
    return single.join(F.broadcast(sums)).select("source", F.greatest(F.lit(1), F.coalesce(part, F.lit(1))).alias("part"))


def block_slots(sizes: DataFrame, frame: int = FRAME) -> DataFrame:
    """(source, block, release, deadline, slot) of every block; ``sizes`` has (source, part, blocks).

    To the driver come the sums of the table and its heaviest rows, at most ``frame`` of them.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("part")).first()[0] or 0
    shape = "source string, block bigint, release bigint, deadline bigint, slot bigint"
    if not total:
        return spark.createDataFrame([], shape)
    heavy = F.col("part") * frame >= total
    named = sizes.filter(heavy).orderBy("part", "source").collect()  # each has 1 / frame of the total or more
    light = sizes.filter(~heavy)
    pooled = light.agg(F.sum("part")).first()[0] or 0
    if pooled and pooled * frame < total and named:  # too light for a member: the lightest member joins them
        joined, named = named[0], named[1:]
        light = sizes.filter(~heavy | F.col("source").eqNullSafe(F.lit(joined.source)))
        pooled += joined.part
    ends = [-(-(r.blocks + 1) * total // r.part) for r in named]
    own = [(r.source, r.part) for r in named]
    waiting = None
    if pooled:
        # In the pool's own time the window of block j is (j to j + 1) pooled / part; blocks go by its middle.
        due = (2 * F.col("block") + 1) * pooled / (2 * F.col("part"))
        waiting = light.select("source", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        waiting = waiting.withColumn("__cell", F.floor(due / frame))
        before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = waiting.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.select("__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
        rank = F.row_number().over(Window.partitionBy("__cell").orderBy(due, "source", "block")) - 1
        waiting = waiting.withColumn("__rank", rank).join(counts, "__cell")
        waiting = waiting.select("source", "part", "block", (F.col("__start") + F.col("__rank")).alias("__j"))
        blocks = light.agg(F.sum("blocks")).first()[0]
        ends.append(-(-(blocks + 1) * total // pooled))
    frames = -(-max(ends) // frame)
    members = [*(p for _, p in own), *([pooled] if pooled else [])]
    parts = F.transform(F.split(F.lit(",".join(map(str, members))), ","), lambda x: x.cast("long"))
    begin = F.col("id") * frame
    dealt = (
        spark.range(0, frames, 1, min(frames, partitions(spark)))
        .select(begin.alias("start"), F.posexplode(_frame_order(parts, begin, frame, total)).alias("at", "x"))
        .select(F.col("x.i").alias("__i"), F.col("x.j").alias("__j"), (F.col("start") + F.col("at")).alias("slot"))
    )
    when = lambda j, p: (_div(j * total, p).alias("release"), _ceil_div((j + 1) * total, p).alias("deadline"))
    sources = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(own)], "__i int, source string, part bigint")
    one_by_one = dealt.join(F.broadcast(sources), "__i")
    found = one_by_one.select("source", F.col("__j").alias("block"), *when(F.col("__j"), F.col("part")), "slot")
    if waiting is not None:
        of_pool = dealt.filter(F.col("__i") == len(own)).select("__j", "slot").join(waiting, "__j")
        found = found.unionByName(of_pool.select("source", "block", *when(F.col("block"), F.col("part")), "slot"))
    return found


def default_weights(documents: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, weight): each source's rows to the power ``temperature``."""
    counted = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("source", F.pow("n", F.lit(temperature)).alias("weight"))


def schedule(documents: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, frame: int = FRAME) -> DataFrame:
    """The input as ``row`` with its block, row_in_block, release, deadline and slot.

    ``weights`` (source, weight) may leave sources out: they have the least weight.
    """
    rows = documents.select(F.struct("*").alias("row"), "source", "doc_id")
    numbered = dense_index(rows, ["source"], ["doc_id"], BUCKET_ROWS, "number", ["doc_id", "source"])
    counted = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    given = whole_parts(default_weights(documents) if weights is None else weights).withColumnRenamed("source", "s")
    met = counted.join(given, F.col("source").eqNullSafe(F.col("s")), "left")
    blocks = F.ceil(F.col("n") / block_rows).cast("long").alias("blocks")
    sizes = materialize(met.select("source", F.coalesce("part", F.lit(1)).alias("part"), blocks))
    slots = materialize(block_slots(sizes, frame))  # its size is then known, and rows are not shuffled to meet a small table
    slots = slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "release", "deadline", "slot")
    block = _div(F.col("number"), F.lit(block_rows))
    met = numbered.withColumn("block", block).join(
        slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    )
    return met.select(
        "row", "block", F.pmod("number", F.lit(block_rows)).cast("int").alias("row_in_block"), "release", "deadline", "slot"
    )


def mix_plan(documents: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row for each document: doc_id, source, block, row_in_block, release, deadline and slot."""
    planned = schedule(documents.select("doc_id", "source"), weights)
    return planned.select("row.doc_id", "row.source", "block", "row_in_block", "release", "deadline", "slot")


def mixed(documents: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """All rows in the order of the mix: partitions follow each other, and rows within them."""
    planned = schedule(documents, weights)
    order = ["slot", "row_in_block"]
    return (
        planned.repartitionByRange(partitions(documents.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select("row.*")
    )
