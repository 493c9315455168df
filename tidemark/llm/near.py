"""Near copies of whole texts: exact similarity of shingle sets, behind wide SimHash fingerprints and least keys.

Texts are sets of five-word shingles, and near means a Jaccard similarity of 0.8 or more, counted on the sets (of 64-bit
hashes) themselves. Fingerprints and keys only rule pairs out, and so loosely that they lose next to nothing:

* Candidates share one of ``KEYS`` keys, each made of the shingles that are least under ``ROWS`` orders: a pair of
  similarity 0.8 misses all of them once in nine thousand million times.
* A fingerprint has 512 bits, each the majority of a bit over the hashes of the distinct shingles. Two sets of similarity
  0.8 differ in about 78 of them, sets of 4 and 5 shingles in about 96; over ``MOST_BITS`` lie at most one in eight
  thousand million of these pairs, and fewer of longer texts.

Within a key, fingerprints carry their Hamming distances to reference fingerprints; pairs whose greatest coordinate
difference is over the threshold are discarded by the triangle inequality. What is left joins sets to families: all
pairs of near copies lie within one. Each family then gets its sets, and a pair links if its similarity, counted
exactly, is 0.8 or more. Keys and families give spanning forests, not all their pairs, and those with many members are
dealt out as pairs of chunks. Components are found over distinct sets.

Defined results: null, empty and blank texts have no shingles and are copies of each other; fewer than five
words make one shingle; A-Z are lowered; a very long text is one set of shingles, counted whole; rows without a doc_id stay; rows that share a doc_id stay or go by their own
texts; an empty table gives an empty result; ``keep_first`` returns the input's columns whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, materialize, release
from tidemark.llm.simhash import GROUP, components

SHINGLE = 5
SEED = 42
#: Near copies have NEAR of SCALE parts of their shingles in common, or more.
NEAR, SCALE = 4, 5
#: 64-bit words of a fingerprint, and the most differing bits of a candidate.
WIDTH, MOST_BITS = 8, 155
#: Keys of a text, and orders that a key takes the least shingle of.
KEYS, ROWS = 32, 3
PIVOTS = 16
#: Shingles of a chunk of a family.
CHUNK_SHINGLES = 1 << 20

_WORDS = re.compile(WORD_PATTERN.encode())
_U = np.uint64


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of the distinct five-word shingles."""
    words = _WORDS.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes: only A-Z are lowered
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    """Odd multipliers: one for each word of a fingerprint, then one for each order of the keys."""
    return np.random.default_rng(SEED).integers(0, 2**63, WIDTH + KEYS * ROWS, dtype=np.uint64) << _U(1) | _U(1)


def _mixed(hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
    mixed = (hashes ^ hashes >> _U(31)) * factor
    return mixed ^ mixed >> _U(29)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """Majority bits over the hashes; zero where there are none."""
    words = np.zeros(WIDTH, np.uint64)
    for w, factor in enumerate(_factors()[:WIDTH]):
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(hashes), 65536):
            part = _mixed(hashes[lo : lo + 65536], factor).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words[w] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return words


def least_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; none for an empty one."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(KEYS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(hashes), 512):  # all orders at once, a part that fits the cache
        np.minimum(least, _mixed(hashes[None, lo : lo + 512], _factors()[WIDTH:, None]).min(axis=1), out=least)
    least = least.reshape(KEYS, ROWS)
    key = np.zeros(KEYS, np.uint64)
    for r in range(ROWS):
        key = _mixed(key + least[:, r], _U(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def set_name(hashes: np.ndarray) -> bytes:
    """A name of a set of shingles."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def prints(text: Column) -> Column:
    """Struct column of a text's set name, number of distinct shingles, fingerprint and keys."""

    @F.arrow_udf("struct<node:binary,size:bigint,print:binary,keys:array<bigint>>")
    def computed(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            hashes = shingle_hashes(t.as_py() or "")
            rows.append((set_name(hashes), len(hashes), wide_print(hashes).tobytes(), least_keys(hashes)))
        release()
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "size", "print", "keys"])

    return computed(text)


def sets(text: Column) -> Column:
    """Binary column of the sorted 64-bit hashes of a text's distinct shingles."""

    @F.arrow_udf("binary")
    def computed(texts: pa.Array) -> pa.Array:
        found = pa.array([shingle_hashes(t.as_py() or "").tobytes() for t in texts], pa.binary())
        release()
        return found

    return computed(text)


def text_id(text: Column) -> Column:
    """What tells texts apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


@lru_cache(maxsize=1)
def pivots() -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random bit strings."""
    return np.random.default_rng(SEED + 1).integers(0, 2**64, (PIVOTS, WIDTH), dtype=np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def spanning(members: dict[bytes, tuple]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the candidates among sets, given as name: (fingerprint,)."""
    names = sorted(members)
    bits = np.frombuffer(b"".join(members[n][0] for n in names), np.uint64).reshape(-1, WIDTH)
    table = np.stack([differing(bits, p) for p in pivots()], axis=1)
    order = np.argsort(table[:, 0], kind="stable")
    bits, table = bits[order], table[order]
    label = np.arange(len(names))
    reach = np.searchsorted(table[:, 0], table[:, 0] + MOST_BITS, side="right")
    edges = []
    for i in range(len(names) - 1):
        others = np.arange(i + 1, reach[i])
        others = others[label[others] != label[i]]  # a forest needs no link within a tree
        others = others[np.abs(table[others] - table[i]).max(axis=1, initial=0) <= MOST_BITS]
        for j in others[differing(bits[others], bits[i]) <= MOST_BITS].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((names[order[i]], names[order[j]]))
    return edges


def similar(members: dict[bytes, tuple]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the near copies among sets, given as name: (fingerprint, hashes)."""
    names = sorted(members, key=lambda n: (len(members[n][1]), n))
    bits = np.frombuffer(b"".join(members[n][0] for n in names), np.uint64).reshape(-1, WIDTH)
    hashes = [np.frombuffer(members[n][1], np.uint64) for n in names]
    sizes = np.array([len(h) for h in hashes])
    values, places = np.unique(np.concatenate(hashes), return_inverse=True)
    places = np.split(places, np.cumsum(sizes)[:-1])
    reach = np.searchsorted(sizes, sizes * SCALE // NEAR, side="right")
    label, own = np.arange(len(names)), np.zeros(len(values), bool)
    edges = []
    for i in range(len(names) - 1):
        others = np.arange(i + 1, reach[i])
        others = others[label[others] != label[i]]
        others = others[differing(bits[others], bits[i]) <= MOST_BITS]
        if not len(others) or not sizes[i]:
            continue
        own[places[i]] = True
        starts = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
        both = np.add.reduceat(own[np.concatenate([places[j] for j in others.tolist()])], starts, dtype=np.int64)
        own[places[i]] = False
        for j in others[SCALE * both >= NEAR * (sizes[i] + sizes[others] - both)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((names[i], names[j]))
    return edges


def _forests(forest: Callable[[dict[bytes, tuple]], list[tuple[bytes, bytes]]]):
    """Links of the rows (group, pair, node, what ``forest`` needs) that come sorted by group and pair."""

    def made(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        columns = ([e[k] for e in edges] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        group = None
        for batch in batches:
            edges: list[tuple[bytes, bytes]] = []
            for key, pair, node, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, pair) != group:
                    edges += forest(held) if len(held) > 1 else []
                    held, group = {}, (key, pair)
                held[node] = tuple(rest)
            yield made(edges)
        yield made(forest(held) if len(held) > 1 else [])

    return linked


def _dealt(met: DataFrame, group: str, chunks: Column, forest: Callable, needed: list[str]) -> DataFrame:
    """Links (a, b) that ``forest`` finds in each group of ``met``, which is dealt out as pairs of chunks."""
    met = met.withColumn("chunks", chunks.cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.least(own, other) * F.col("chunks").cast("long") + F.greatest(own, other),
    )
    return (
        met.select(group, F.explode(pairs).alias("pair"), "node", *needed)
        .repartition(group, "pair")
        .sortWithinPartitions(group, "pair")
        .mapInArrow(_forests(forest), "a binary, b binary")
        .distinct()
    )


def _chunks(n: str) -> Column:
    return F.when(F.col(n) <= GROUP, F.lit(1)).otherwise(F.ceil(F.col(n) / (GROUP // 2)))


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between sets (node, print, keys): whatever pair may be near is in one of their components."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(shared, "key").join(nodes.select("node", "print"), "node")
    return _dealt(met, "key", _chunks("n"), spanning, ["print"])


def members(edges: DataFrame, name: str) -> DataFrame:
    """(node, ``name``) for each node of ``edges``: the component that it is in."""
    joined = materialize(components(edges))  # a component's smallest node is a member without a row of its own
    return joined.select("node", F.col("component").alias(name)).union(
        joined.select(F.col("component").alias("node"), F.col("component").alias(name)).distinct()
    )


def links(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) between sets of a similarity of 0.8 or more that keep every component whole.

    ``nodes`` has node, size, print, keys and one text of each set (first, text_id).
    """
    family = materialize(members(candidates(nodes.select("node", "print", "keys")), "family").join(nodes.drop("keys"), "node"))
    of_family = family.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    chosen = family.join(of_family, "family").withColumnRenamed("first", "doc_id")
    texts = documents.select("doc_id", "text", text_id(F.col("text")).alias("text_id"))
    same = texts["text_id"].eqNullSafe(chosen["text_id"]) & texts["doc_id"].eqNullSafe(chosen["doc_id"])
    met = texts.join(chosen, same).select("family", "n", "shingles", "node", "print", sets(texts["text"]).alias("hashes"))
    chunks = F.greatest(_chunks("n"), F.ceil(F.col("shingles") / CHUNK_SHINGLES))
    return _dealt(met, "family", chunks, similar, ["print", "hashes"])


def _placed(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, text_id and component_id."""
    text = F.col("text")
    found = materialize(documents.select("doc_id", text_id(text).alias("text_id"), prints(text).alias("p")).select("doc_id", "text_id", "p.*"))
    nodes = materialize(
        found.groupBy("node")
        .agg(F.min(F.struct("doc_id", "text_id")).alias("least"), F.min("doc_id").alias("smallest"), *(F.first(c).alias(c) for c in ("size", "print", "keys")))
        .select("node", "smallest", F.col("least.doc_id").alias("first"), "least.text_id", "size", "print", "keys")
    )
    member = members(links(nodes.drop("smallest"), documents), "component")
    placed = nodes.join(member, "node", "left").select("node", "smallest", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_node = placed.join(smallest, "component").select("node", "component_id")
    return found.select("doc_id", "text_id", "node").join(of_node, "node").select("doc_id", "text_id", "component_id")


def near_components(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id and component_id, the smallest doc_id that chains of near copies reach."""
    return _placed(documents).select("doc_id", "component_id")


def keep_first(documents: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, with all its columns."""
    gone = _placed(documents).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone"), "text_id").distinct()
    same = (documents["doc_id"] == gone["gone"]) & (text_id(documents["text"]) == gone["text_id"])
    return documents.join(gone, same, "left_anti").select(*documents.columns)
