"""A Merkle manifest of a dataset: one tree of digests for each group, their roots under one root, and proofs of rows.

Rows are leaves, in order within their group. Eight consecutive nodes make one of the next level, the last run of a
level what is left, until one node remains, the group's subroot; subroots, in order of their groups, make a tree alike.

Leaves are numbered from counts: rows are dealt out in order, and a part's first number follows from the counts of the
parts before it. Then every task folds what it has into a sparse forest: nodes keyed by tree, level and index that wait
for siblings. A run of siblings whose number is known (from the rows of its group) is replaced by its parent as soon as
it is whole, and a whole tree by a leaf of the tree above. Joining two forests is associative, so the forests of the
tasks are joined in rounds, a few neighbours at a time, each round written to the shared folder. A forest of
neighbouring leaves has two incomplete runs a level at most, so it stays small however many leaves and groups it covers.

Proofs are made by blocks of some levels (``BLOCK_LEVELS``): a block's inner nodes follow from its leaves, and the
siblings above it are joined to it once. Neither leaves nor nodes come to the driver, but for the root.

Defined results: nulls have a mark of their own in a leaf; the null group comes first, and so do null orders; rows with
one order are in the order of their leaves, so repeated rows have leaves of their own and proofs by place; empty texts
have no bytes; a very long text is hashed whole; an empty table has no rows and no root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, partitions, release
from tidemark.llm.ordered import slices

ARITY = 8
#: Levels of a block for proofs.
BLOCK_LEVELS = 4
#: Forests that are joined at a time.
FAN = 16
#: The tree of subroots; others are numbered from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "part bigint, tree bigint, n bigint, level int, idx bigint, digest binary, open boolean"
_NODE_SCHEMA = pa.schema(
    [("part", pa.int64()), ("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("open", pa.bool_())]
)
_PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
)


def field(value: Column) -> Column:
    """A value with its length before it, so that neighbouring fields cannot be mistaken for others; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Iterable[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def parent(digests: list[bytes]) -> bytes:
    """Of the children's hexadecimal digits, concatenated."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def depth(n: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree."""
    found = 0
    while n > 1:
        n, found = -(-n // arity), found + 1
    return found


class Forest:
    """Nodes that wait for siblings. Joining forests is associative: what is whole depends on the nodes alone."""

    def __init__(self, trees: int, arity: int = ARITY) -> None:
        self.trees, self.arity = trees, arity
        self.waiting: dict[tuple[int, int, int], dict[int, bytes]] = {}
        self.sizes: dict[int, int] = {}
        self.made: list[tuple[int, int, int, int, bytes]] = []

    def add(self, tree: int, n: int, level: int, idx: int, digest: bytes) -> None:
        """A node of a tree of ``n`` leaves; parents follow while runs are whole."""
        while True:
            size = -(-n // self.arity**level)
            if size == 1:
                if tree == TOP:
                    return
                tree, n, level, idx = TOP, self.trees, 0, tree
                self.made.append((tree, n, level, idx, digest))
                continue
            run = idx // self.arity
            found = self.waiting.setdefault((tree, level, run), {})
            found[idx] = digest
            self.sizes[tree] = n
            if len(found) < min(self.arity, size - run * self.arity):
                return
            del self.waiting[tree, level, run]
            digest = parent([found[i] for i in sorted(found)])
            level, idx = level + 1, run
            self.made.append((tree, n, level, idx, digest))

    def open(self) -> list[tuple[int, int, int, int, bytes]]:
        """The nodes that still wait."""
        return [(tree, self.sizes[tree], level, idx, d) for (tree, level, _), run in self.waiting.items() for idx, d in run.items()]


def _nodes(part: int, forest: Forest, waiting: bool) -> pa.RecordBatch:
    rows = [(part, *x, False) for x in forest.made] + ([(part, *x, True) for x in forest.open()] if waiting else [])
    forest.made = []
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NODE_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE_SCHEMA, strict=True)], schema=_NODE_SCHEMA)


def _folded(trees: int, arity: int):
    """Rows (part, tree, n, idx, leaf) of a task to its forest and the nodes made on the way."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, first = Forest(trees, arity), None
        for batch in slices(batches, 5000):
            for part, tree, n, idx, leaf in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                first = part if first is None else first
                forest.add(tree, n, 0, idx, leaf)
            yield _nodes(first or 0, forest, False)
        yield _nodes(first or 0, forest, True)
        release()

    return fold


def _joined(trees: int, arity: int, reach: int):
    """The forests of ``reach`` neighbouring parts to one."""

    def join(key: tuple, group: pa.Table) -> pa.Table:
        forest = Forest(trees, arity)
        for row in zip(*(group.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest")), strict=True):
            forest.add(*row)
        return pa.Table.from_batches([_nodes(key[0].as_py() * reach, forest, True)])

    return join


@dataclass
class Manifest:
    """``leaves``: tree, n, idx and the rows' other columns. ``nodes``: tree, n, level, idx and digest of all inner nodes."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    arity: int
    block_levels: int
    root: bytes | None


def numbered(leaves: DataFrame) -> tuple[DataFrame, int]:
    """``leaves`` (group, doc_id, leaf, ...) with part, tree, n and idx, in order within each file; and how many trees there are."""
    spark = leaves.sparkSession
    # One text for the group, null before all others, in the order of its bytes.
    keyed = materialize(leaves.withColumn("__key", F.coalesce(F.concat(F.lit("1"), F.col("group")), F.lit("0"))).drop("group"))
    order = ["__key", "doc_id", "leaf"]
    dealt = materialize(keyed.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id().cast("long")))
    of_key, upto = Window.partitionBy("__key"), Window.partitionBy("__key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("part", "__key").agg(F.count(F.lit(1)).alias("here"))
    counts = counts.select("part", "__key", F.coalesce(F.sum("here").over(upto), F.lit(0)).alias("start"), F.sum("here").over(of_key).alias("n"))
    # Trees are numbered by the parts that they begin in: one row for each part is ordered together, not one for each tree.
    begun = counts.filter("start = 0")
    each = begun.groupBy("part").agg(F.count(F.lit(1)).alias("here"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("first"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("__key")) - 1
    tree = begun.withColumn("local", local).join(each, "part").select("__key", (F.col("first") + F.col("local")).alias("tree"))
    places = materialize(counts.join(tree, "__key"))
    trees = (places.agg(F.max("tree")).first()[0] or 0) + 1
    rank = F.row_number().over(Window.partitionBy("part", "__key").orderBy("doc_id", "leaf")) - 1
    met = dealt.withColumn("rank", rank).join(places, ["part", "__key"])
    rest = [c for c in dealt.columns if c not in ("part", "__key", "leaf")]
    return met.select("part", "tree", "n", (F.col("start") + F.col("rank")).alias("idx"), "leaf", *rest), trees


def manifest(leaves: DataFrame, arity: int = ARITY, fan: int = FAN, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of ``leaves`` (group, doc_id, leaf, and columns that are kept)."""
    spark = leaves.sparkSession
    found, trees = numbered(leaves)
    found = materialize(found)
    made = [materialize(found.select("part", "tree", "n", "idx", "leaf").mapInArrow(_folded(trees, arity), _NODE))]
    reach = 1
    while reach == 1 or reach < partitions(spark):
        reach *= fan
        waiting = made[-1].filter("open")
        neighbours = F.call_function("div", F.col("part"), F.lit(reach)).alias("neighbours")
        made.append(materialize(waiting.groupBy(neighbours).applyInArrow(_joined(trees, arity, reach), _NODE)))
    nodes = made[0]
    for more in made[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.filter("not open").select("tree", "n", "level", "idx", "digest")
    root = nodes.filter((F.col("tree") == TOP) & (F.col("level") == depth(trees, arity)) & (F.col("idx") == 0)).first()
    return Manifest(found, nodes, trees, arity, block_levels, None if root is None else bytes(root.digest))


def _levels(n: Column, arity: int) -> Column:
    """``depth`` as a column."""
    powers = F.array(*[F.lit(arity**k).cast("long") for k in range(63) if arity**k < 1 << 63])
    return F.size(F.filter(powers, lambda p: p < n))


def _paths(made: Manifest) -> DataFrame:
    """(tree, block, subroot, path): the siblings above each block, level by level; ``own`` is the place among them."""
    arity, height, leaves = made.arity, made.block_levels, made.arity**made.block_levels
    div = lambda a, b: F.call_function("div", a, b)
    member = F.struct("idx", "digest")
    runs = made.nodes.filter((F.col("tree") == TOP) | (F.col("level") >= height))
    runs = runs.groupBy("tree", "level", div(F.col("idx"), F.lit(arity)).alias("run")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    sizes = made.leaves.select("tree", "n").groupBy("tree").agg(F.first("n").alias("n"))
    blocks = sizes.select("tree", "n", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("n") - 1, F.lit(leaves)))).alias("block"))
    power = F.array(*[F.lit(arity**k).cast("long") for k in range(63) if arity**k < 1 << 63])

    def steps(rows: DataFrame, keys: list[str], own: Column, tree: Column, first: int, n: Column, base: int) -> DataFrame:
        """One row for each level from ``first`` to below the root, joined to the run there."""
        levels = F.explode(F.filter(F.sequence(F.lit(first), F.greatest(_levels(n, arity) - 1, F.lit(first))), lambda k: F.get(power, k) < n))
        at = rows.select(*keys, own.alias("own"), tree.alias("of"), levels.alias("level"))
        at = at.withColumn("own", div(F.col("own"), F.get(power, F.col("level") - first)))
        met = at.withColumn("run", div(F.col("own"), F.lit(arity))).join(runs.withColumnRenamed("tree", "of"), ["of", "level", "run"])
        return met.select(*keys, F.struct((F.col("level") + base).alias("level"), "own", "members").alias("step"))

    below = steps(blocks, ["tree", "block"], F.col("block"), F.col("tree"), height, F.col("n"), 0)
    inner = below.groupBy("tree", "block").agg(F.array_sort(F.collect_list("step")).alias("inner"))
    above = steps(sizes, ["tree"], F.col("tree"), F.lit(TOP).cast("long"), 0, F.lit(made.trees), 100)
    outer = above.groupBy("tree").agg(F.array_sort(F.collect_list("step")).alias("outer"))
    subroots = made.nodes.filter((F.col("tree") == TOP) & (F.col("level") == 0)).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"))
    none = F.array().cast("array<struct<level:int,own:bigint,members:array<struct<idx:bigint,digest:binary>>>>")
    found = blocks.drop("n").join(subroots, "tree").join(inner, ["tree", "block"], "left").join(outer, "tree", "left")
    return found.select("tree", "block", "subroot", F.concat(F.coalesce("inner", none), F.coalesce("outer", none)).alias("path"))


def _proved(arity: int, height: int, root: bytes):
    """Leaves of one block and the siblings above it to proofs, and to roots folded from what rows claim to be."""

    def prove(leaves: pa.Table, paths: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("idx")
        doc_ids, claims = leaves.column("doc_id").to_pylist(), leaves.column("claimed").to_pylist()
        n = leaves.column("n")[0].as_py()
        level = [d.hex() for d in leaves.column("leaf").to_pylist()]
        inner, digests = [], level
        for _ in range(min(height, depth(n, arity))):
            runs = [digests[i : i + arity] for i in range(0, len(digests), arity)]
            inner.append(runs)
            digests = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
        path, subroot = paths.column("path")[0].as_py(), paths.column("subroot")[0].as_py().hex()
        above = []
        for step in path:
            members = [(x["idx"], x["digest"].hex()) for x in step["members"]]
            above.append(("".join(d for i, d in members if i < step["own"]), "".join(d for i, d in members if i > step["own"])))
        shared = "".join(a + b for a, b in above)
        whole, rows = root.hex(), []
        for k, (doc_id, leaf, claim) in enumerate(zip(doc_ids, level, claims, strict=True)):
            siblings, at = [], k
            for runs in inner:
                run, place = runs[at // arity], at % arity
                siblings.append(("".join(run[:place]), "".join(run[place + 1 :])))
                at //= arity
            proof = "".join(a + b for a, b in siblings) + shared
            folded = leaf if claim is None else claim.hex()
            for a, b in (*siblings, *above):
                folded = hashlib.sha256((a + folded + b).encode()).hexdigest()
            rows.append((doc_id, leaf, subroot, whole, hashlib.sha256(proof.encode()).hexdigest(), folded, folded == whole))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PROOF_SCHEMA, strict=True)], schema=_PROOF_SCHEMA)

    return prove


def proofs(made: Manifest) -> DataFrame:
    """One row for each leaf: its proof in short, and whether the leaf that it claims (``claimed``, or its own) leads to the root."""
    spark = made.leaves.sparkSession
    if made.root is None:
        return spark.createDataFrame([], _PROOF)
    block = F.call_function("div", F.col("idx"), F.lit(made.arity**made.block_levels))
    leaves = made.leaves.select("tree", block.alias("block"), "n", "idx", "doc_id", "leaf", "claimed")
    paths = materialize(_paths(made))
    return leaves.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(_proved(made.arity, made.block_levels, made.root), _PROOF)


def tampered(documents: DataFrame) -> DataFrame:
    """(group, doc_id, leaf, claimed) of documents; every third by the hash of its doc_id claims a text in small letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    own = [F.col(c) for c in FIELDS]
    lower = [*own[:-1], F.translate("text", letters, letters.lower())]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return documents.select(F.col("lang").alias("group"), "doc_id", leaf_digest(own).alias("leaf"), F.when(chosen, leaf_digest(lower)).alias("claimed"))


def proof_query(documents: DataFrame) -> DataFrame:
    return proofs(manifest(tampered(documents)))
