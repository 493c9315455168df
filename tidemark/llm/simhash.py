"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of its three-word
shingles. Two fingerprints link at ``MAX_BITS`` or fewer differing bits; components are found over distinct
fingerprints, so copies of a text never meet as pairs.

Candidates come from blocks: the bits fall into six blocks, and two fingerprints with at most three differing bits
agree on three whole blocks at least, so each of the 20 choices of three blocks is a key of 31 to 33 bits and no
link is missed. Within a key, fingerprints meet by pivots: each carries its Hamming distances to reference
fingerprints, members are sorted by the first distance, pairs whose greatest coordinate difference is over the
threshold are discarded by the triangle inequality, and survivors are verified. A key gives a spanning forest of
its links, not all its pairs. Keys with many members are dealt out as pairs of chunks.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; fewer than three words
make one shingle; copies share a fingerprint; a very long text is hashed whole, in parts; rows with a null doc_id get a fingerprint but, if alone in a
component, a null component_id; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, materialize, release

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Widths of the six blocks of a fingerprint, from its low bits.
BLOCKS = (11, 11, 11, 11, 10, 10)
PIVOTS = 16
#: Members of a key that are compared in one group; more are dealt out in chunks of half as many.
GROUP = 2048

_WORDS = re.compile(WORD_PATTERN.encode())


def fingerprint(text: str) -> int:
    """Majority bits of the shingle hashes; zero for a text without words."""
    words = _WORDS.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes: only A-Z are lowered
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(text: Column) -> Column:
    """Fingerprints of a text column, as signed 64-bit integers."""

    @F.arrow_udf("bigint")
    def computed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py() or "") for t in texts), np.uint64, len(texts))
        release()
        return pa.array(found.view(np.int64))

    return computed(text)


@lru_cache(maxsize=1)
def pivots() -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random bit strings."""
    return np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot."""
    return np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int16)


def _spanning(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between the distinct ``prints``."""
    table = pivot_table(prints)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    parent = list(range(len(prints)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    reach = np.searchsorted(table[:, 0], table[:, 0] + MAX_BITS, side="right")
    for i in range(len(prints) - 1):
        others = np.arange(i + 1, reach[i])
        if not others.size:
            continue
        near = np.abs(table[others] - table[i]).max(axis=1) <= MAX_BITS
        others = others[near]
        for j in others[np.bitwise_count(prints[others] ^ prints[i]) <= MAX_BITS]:
            a, b = root(i), root(int(j))
            if a != b:
                parent[b] = a
                edges.append((int(prints[i]), int(prints[j])))
    return edges


def _block_keys(prints: DataFrame) -> DataFrame:
    """Each fingerprint under its 20 keys: number of the choice and the bits of its three blocks."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    masks = []
    for chosen in combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS):
        mask = sum(((1 << BLOCKS[b]) - 1) << starts[b] for b in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keys = F.array(
        *[F.struct(F.lit(i).cast("tinyint").alias("choice"), F.col("print").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]
    )
    return prints.select("print", F.explode(keys).alias("key")).select("print", "key.choice", "key.bits")


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the rows (choice, bits, pair, print) that come sorted by group."""
    held: list[np.ndarray] = []
    held_key: tuple | None = None

    def flush(out: list[tuple[int, int]]) -> None:
        members = np.unique(np.concatenate(held)) if held else np.empty(0, np.uint64)
        if members.size > 1:
            out.extend(_spanning(members))

    for batch in batches:
        out: list[tuple[int, int]] = []
        n = batch.num_rows
        if not n:
            continue
        choice, bits, pair = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        prints = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        new = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]) | (pair[1:] != pair[:-1])) + 1
        edges = [0, *new.tolist(), n]
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = (choice[lo], bits[lo], pair[lo])
            if key != held_key:
                flush(out)
                held, held_key = [], key
            held.append(prints[lo:hi].copy())
        if out:
            yield _edge_batch(out)
    out = []
    flush(out)
    yield _edge_batch(out)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``print``) that keep every component whole."""
    keyed = _block_keys(prints)
    shared = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Keys of one member link nothing. A key of more than GROUP members becomes pairs of chunks.
    half = GROUP // 2
    met = keyed.join(shared, ["choice", "bits"]).withColumn(
        "chunks", F.when(F.col("n") <= GROUP, F.lit(1)).otherwise(F.ceil(F.col("n") / half)).cast("int")
    )
    own = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.least(own, other) * F.col("chunks") + F.greatest(own, other),
    )
    dealt = met.select("choice", "bits", F.explode(pairs).alias("pair"), "print")
    return (
        dealt.repartition("choice", "bits", "pair")
        .sortWithinPartitions("choice", "bits", "pair")
        .mapInArrow(_link_groups, "a bigint, b bigint")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node reachable.

    Rounds of large-star and small-star: each node's neighbours are hooked to the smallest among them. Every round
    is written to the shared folder, and the edges shrink to stars in a number of rounds that grows with the
    logarithm of the longest chain.
    """
    edges = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = signature(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        down = large.filter("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = materialize(small.select("e.a", "e.b").filter("a > b").distinct())
        after = signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def simhash_components(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable)."""
    prints = materialize(documents.select("doc_id", fingerprints(F.col("text")).alias("print")))
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes.select("print")))
    # a component's own smallest fingerprint is a member without a row of its own
    member = found.select(F.col("node").alias("print"), "component").union(
        found.select(F.col("component").alias("print"), "component").distinct()
    )
    joined = nodes.join(member, "print", "left").select(
        "print", "first", F.coalesce("component", "print").alias("component")
    )
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = joined.join(smallest, "component").select("print", "component_id")
    return prints.join(of_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(documents: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, with all its columns.

    Rows without a doc_id stay.
    """
    found = simhash_components(documents)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
