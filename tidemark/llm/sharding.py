"""Shards of equal bytes by a k-d tree over document metadata.

Points are texts: documents with equal texts move together. A group of copies larger than ``PIECE`` of a shard is cut
into pieces of about that size, which are points of their own at the same place, so that copies stay in as few shards as
equal bytes allow. A node of the tree is split at the weighted median along its widest dimension (a weighted quantile
where it has an odd number of shards to fill), until each leaf is one shard of the target bytes.

A level of the tree is a table of its nodes. Extents and histograms of weights are grouped by node, medians are looked up
by windows over a node's bins, and points meet the table to learn their next node; histograms are refined until no bin
matters. Nothing of the tree comes to the driver, so the number of leaves has no limit there.

Dimensions are whole numbers, scaled by their extent over the corpus: bytes of the text, language, source and
place in the table (doc_id). A fraction from a hash is added to each, so ties split anywhere and a dimension that is
constant can still be cut.

Defined results: null is the empty text; null languages, sources and doc_ids have a place of their own; repeated
rows are points or parts of one; a very long text is one point, and a shard that it fills alone is as large as it; an
empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dense_index, materialize, utf8_length

SHARDS = 24
#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: Pieces of a group of copies, as part of a shard's bytes: what a cut may be off by.
PIECE = 0.02
#: Keys that the copies of one text are spread over.
SALTS = 16
#: Bins of a node's histogram, and the part of a shard's bytes to which a cut is exact.
BINS, EXACT = 1 << 16, 0.0005
#: Refinements of a cut at most: each divides the range by ``BINS``.
REFINEMENTS = 5
#: Bytes of the text, language, source, doc_id.
DIMENSIONS = 4


def _code(value: Column, kinds: int) -> Column:
    return F.when(value.isNull(), kinds).otherwise(F.pmod(F.xxhash64(value), F.lit(kinds))).cast("double")


def points(documents: DataFrame, target: float) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions (dims) of each document; nothing of the text itself."""
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        documents.select(
            "doc_id",
            (utf8_length(F.col("text")) + ROW_BYTES).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
            "lang",
            "source",
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        )
    )
    same = ["hash", "text_crc32", "size"]
    groups = (
        rows.groupBy(*same)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("doc_id").alias("g_place"),
            F.min("lang").alias("g_lang"),
            F.min("source").alias("g_source"),
        )
        .filter("n > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    met = rows.join(groups, [*same, "salt"], "left")
    group = F.col("n").isNotNull()
    pieces = F.ceil(F.col("n") * F.col("size") / (PIECE * target)).cast("long")
    # Rows are dealt to pieces by hash; where a piece holds less than two, each row is one.
    deal = F.xxhash64("doc_id", F.lit(1))
    piece = F.when(2 * pieces <= F.col("n"), F.pmod(deal, pieces)).when(pieces > 1, deal).otherwise(0)
    own = F.when(group, F.xxhash64("hash", "text_crc32", piece)).otherwise(F.xxhash64("doc_id", "hash"))
    fraction = F.pmod(own, F.lit(1 << 30)) / (1 << 30)
    pick = lambda a, b: F.when(group, F.col(a)).otherwise(F.col(b))
    places = (
        F.col("size"),
        _code(pick("g_lang", "lang"), 64),
        _code(pick("g_source", "source"), 4096),
        F.coalesce(pick("g_place", "doc_id"), F.lit(-1)).cast("double"),
    )
    return met.select("doc_id", "size", "text_crc32", F.array(*[x + fraction for x in places]).alias("dims"))


def _extents(placed: DataFrame, whole: list[float]) -> DataFrame:
    """The nodes that are to be split: (node, leaves), widest dimension d, its range, and the bytes wanted on its left."""
    each = [f(F.col("dims")[i]) for i in range(DIMENSIONS) for f in (F.min, F.max)]
    found = placed.filter("leaves > 1").groupBy("node", "leaves").agg(F.sum("size").alias("bytes"), F.array(*each).alias("ends"))
    low, high = (lambda i: F.col("ends")[2 * i]), (lambda i: F.col("ends")[2 * i + 1])
    spans = [F.struct(((high(i) - low(i)) / whole[i]).alias("w"), F.lit(-i).alias("d")) for i in range(DIMENSIONS)]
    found = found.withColumn("d", -F.array_max(F.array(*spans))["d"])
    return found.select(
        "node",
        "leaves",
        "d",
        F.get("ends", 2 * F.col("d")).alias("low"),
        (F.get("ends", 2 * F.col("d") + 1) * (1 + 1e-12) + 1e-9).alias("high"),  # the range is open at its end
        (F.ceil(F.col("leaves") / 2) / F.col("leaves") * F.col("bytes")).alias("want"),
        F.lit(0).cast("long").alias("below"),
        F.lit(None).cast("double").alias("cut"),
        F.lit(False).alias("done"),
    )


def _refined(placed: DataFrame, nodes: DataFrame, tolerance: float) -> DataFrame:
    """The nodes with their range narrowed to the bin in which the wanted bytes are reached, and the cut at its nearer end."""
    value, width = F.get("dims", F.col("d")), F.greatest((F.col("high") - F.col("low")) / BINS, F.lit(1e-300))
    known = nodes.filter("not done").withColumn("s", F.struct(*nodes.columns))
    met = placed.select("node", "dims", "size").join(known, "node").filter((value >= F.col("low")) & (value < F.col("high")))
    at = F.least(F.floor((value - F.col("low")) / width), F.lit(BINS - 1)).cast("int").alias("bin")
    bins = met.groupBy("node", at).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.first("s").alias("s"))
    upto = F.sum("b").over(Window.partitionBy("node").orderBy("bin"))
    reached = bins.withColumn("upto", upto).filter("s.below + upto >= s.want")
    met = reached.groupBy("node").agg(F.min_by(F.struct("bin", "b", "n", "upto", "s"), "bin").alias("x")).select("x.*", "x.s.*")
    low = F.col("low") + F.col("bin") * width
    high = F.when(F.col("bin") == BINS - 1, F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * width)
    below = F.col("below") + F.col("upto") - F.col("b")
    nearer = F.when(F.col("want") - below <= below + F.col("b") - F.col("want"), low).otherwise(high)
    fine = (F.col("b") <= tolerance) | (F.col("n") <= 1) | (low + (high - low) / 2 <= low)
    narrowed = met.select(
        "node", "leaves", "d", low.alias("low"), high.alias("high"), "want", below.alias("below"), nearer.alias("cut"), fine.alias("done")
    )
    return narrowed.unionByName(nodes.filter("done"))


def _split(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points in the children of their nodes; a node is named by the first of its shards."""
    met = placed.join(nodes.select("node", "d", "cut"), "node", "left")
    half = F.ceil(F.col("leaves") / 2).cast("int")
    is_right = F.get("dims", F.col("d")) >= F.col("cut")
    node = F.when(is_right, F.col("node") + half).otherwise(F.col("node"))
    leaves = F.when(is_right, F.col("leaves") - half).when(F.col("leaves") > 1, half).otherwise(F.col("leaves"))
    return met.select("doc_id", "size", "text_crc32", "dims", node.alias("node"), leaves.alias("leaves"))


def leaves(points: DataFrame, shards: int, target: float) -> DataFrame:
    """The points with the leaf (node) of the k-d tree that they are in."""
    spans = points.agg(*[f(F.col("dims")[i]) for i in range(DIMENSIONS) for f in (F.min, F.max)]).first()
    whole = [max((spans[2 * i + 1] or 0) - (spans[2 * i] or 0), 1e-9) for i in range(DIMENSIONS)]
    placed = points.withColumn("node", F.lit(0)).withColumn("leaves", F.lit(shards))
    if spans[0] is None:  # no row
        return placed
    for _ in range(max(0, shards - 1).bit_length()):
        nodes = materialize(_extents(placed, whole))
        for _ in range(REFINEMENTS):
            nodes = materialize(_refined(placed, nodes, EXACT * target))
            if nodes.filter("not done").isEmpty():
                break
        placed = materialize(_split(placed, nodes))
    return placed


def kd_shards(documents: DataFrame, shards: int | None = SHARDS, target_bytes: float | None = None) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, shard, and slot: its gapless number in the shard.

    Give the number of shards, or the bytes of one.
    """
    total = documents.agg(F.sum(utf8_length(F.col("text")) + ROW_BYTES)).first()[0] or 0
    shards = shards or max(1, math.ceil(total / target_bytes))
    target = max(total / shards, 1)
    found = leaves(materialize(points(documents, target)), shards, target)
    placed = found.select("doc_id", "size", "text_crc32", F.col("dims")[DIMENSIONS - 1].alias("d_place"), F.col("node").alias("shard"))
    salt = ["doc_id", "text_crc32", "d_place"]
    return dense_index(placed, ["shard"], ["doc_id", "text_crc32"], 50_000, "slot", salt).drop("d_place")


def shard_query(documents: DataFrame) -> DataFrame:
    return kd_shards(documents).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
