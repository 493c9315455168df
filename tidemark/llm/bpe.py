"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens. A chunk of documents keeps its own list of distinct words and each document as
positions in that list; the words go out by hash, one entry for each chunk that has them, so that every distinct
word of the corpus is encoded once, in one task. The ids return to the chunks, where documents are put together
again by position. Decoding joins ids to the table of token bytes.

Words travel packed: one compressed block for each chunk and hash range, in the order in which ids return. The
number of ranges follows the shuffle partitions, so a range stays as large as a partition when both grow with the
corpus. A word that is in every chunk costs one entry a chunk, whatever its count in documents.

Defined results: null and empty texts have no tokens; repeated rows are encoded alike; a very long text
is one document of its chunk, which may then be as large as it; an empty table gives an empty result; other columns are neither read nor returned. Lone surrogates cannot be in a Spark string.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, release
from tidemark.llm.ordered import slices

#: Characters of text that a chunk gathers before its words go out: the least, the most, and those for each hash range
#: between them, so that a block has enough words to be worth a row when ranges grow with the corpus.
CHUNK_CHARS, MOST_CHUNK_CHARS, CHARS_PER_RANGE = 2 << 20, 32 << 20, 512
#: Hash ranges of words for each shuffle partition; a range is one group.
RANGES_PER_PARTITION = 4

_ROUTED = "route bigint, bucket int, chunk bigint, body binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_table(path: str) -> list[bytes]:
    """Bytes of each token by id; unused ids are empty."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


@lru_cache(maxsize=1)
def _encoding(ranks: Broadcast, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})


def _pack(items: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, items), np.uint32, len(items))
    return zstandard.compress(np.uint32(len(items)).tobytes() + sizes.tobytes() + b"".join(items), 3)


def _unpack(block: bytes) -> list[bytes]:
    raw = zstandard.decompress(block)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]


def _routed(rows: list[tuple[int, int | None, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["route", "bucket", "chunk", "body"])


class _Chunk:
    """Documents of a chunk as positions in the chunk's list of distinct words."""

    def __init__(self, number: int) -> None:
        self.number, self.index, self.chars = number, {}, 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.positions: list[np.ndarray] = []

    def add(self, doc_id: int | None, words: list[str], chars: int) -> None:
        index = self.index
        at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint32, len(words))
        self.ids.append(doc_id)
        self.lengths.append(len(at))
        self.positions.append(at)
        self.chars += chars

    def rows(self, buckets: int) -> list[tuple[int, int | None, int, bytes]]:
        """The chunk's documents under its own route, and its words under those of their buckets."""
        at = np.concatenate([np.empty(0, np.uint32), *self.positions])
        words = [w.encode() for w in self.index]
        # Words are numbered by how often the chunk has them, so most numbers are small and pack well.
        common = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[common] = np.arange(len(words), dtype=np.uint32)
        bucket = np.fromiter((zlib.crc32(words[i]) % buckets for i in common.tolist()), np.int32, len(words))
        flags = np.array([d is None for d in self.ids], np.uint8).tobytes()
        ids = np.array([d or 0 for d in self.ids], np.int64).tobytes()
        planes = np.ascontiguousarray(rank[at].view(np.uint8).reshape(-1, 4).T)
        body = _pack([ids, flags, np.array(self.lengths, np.int64).tobytes(), planes.tobytes(), bucket.tobytes()])
        out: list[tuple[int, int | None, int, bytes]] = [(buckets + self.number, None, self.number, body)]
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            mine = [words[i] for i in common[order[edges[b] : edges[b + 1]]].tolist()]
            out.append((b, b, self.number, _pack(mine)))
        return out


def _split(pattern: str, buckets: int, chunk_chars: int):
    """Documents (doc_id, text) to chunks. A chunk's number is its task's and its own within the task."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        task = TaskContext.get().partitionId()
        count = 0
        chunk = _Chunk(task << 24)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk.add(doc_id, find(text or ""), len(text or ""))
                if chunk.chars >= chunk_chars:
                    yield _routed(chunk.rows(buckets))
                    count += 1
                    chunk = _Chunk((task << 24) + count)
        if chunk.ids:
            yield _routed(chunk.rows(buckets))
        release()

    return split


def _encode(ranks: Broadcast, pattern: str, buckets: int):
    """Words of one bucket from all chunks: each distinct word is encoded once, each chunk gets its ids."""

    def encode(group: pa.Table) -> pa.Table:
        encoding = _encoding(ranks, pattern)
        known: dict[bytes, list[int]] = {}
        out = []
        columns = (group.column(c).to_pylist() for c in ("bucket", "chunk", "body"))
        for bucket, chunk, body in zip(*columns, strict=True):
            if bucket is None:
                continue
            counts, ids = [], []
            for word in _unpack(body):
                if (found := known.get(word)) is None:
                    found = known[word] = encoding.encode_ordinary(word.decode())
                counts.append(len(found))
                ids += found
            reply = _pack([np.array(counts, np.uint32).tobytes(), np.array(ids, np.uint32).tobytes()])
            out.append((buckets + chunk, bucket, chunk, reply))
        return pa.Table.from_batches([_routed(out)])

    return encode


def _bytes_of(tokens: pa.ListArray, table: list[bytes]) -> pa.Array:
    """Join each list of ids to the table of token bytes."""
    values, ends = tokens.values.to_numpy(), tokens.offsets.to_pylist()
    spans = zip(ends, ends[1:], strict=False)
    return pa.array([b"".join([table[i] for i in values[a:b].tolist()]) for a, b in spans], pa.binary())


def _assemble(table: Broadcast | None):
    """Documents of a chunk, put together from the ids of its words; decoded as well where a table is given."""

    def assemble(own: pa.Table, replies: pa.Table) -> pa.Table:
        bodies = own.filter(pc.is_null(own.column("bucket"))).column("body").to_pylist()
        blocks = sorted(zip(replies.column("bucket").to_pylist(), replies.column("body").to_pylist(), strict=True))
        parts = [[np.frombuffer(x, np.uint32) for x in _unpack(block)] for _, block in blocks]
        empty = [np.empty(0, np.uint32)]
        size = np.concatenate(empty + [counts for counts, _ in parts]).astype(np.int64)
        flat = np.concatenate(empty + [ids for _, ids in parts])
        start = np.cumsum(size) - size
        doc_ids, values, offsets = [], [], [0]
        for body in bodies:
            kinds = (np.int64, np.uint8, np.int64, np.uint8, np.int32)
            ids, missing, lengths, planes, bucket = (np.frombuffer(x, t) for x, t in zip(_unpack(body), kinds, strict=True))
            ranks = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
            place = np.empty(len(bucket), np.uint32)  # of each word among the replies
            place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket), dtype=np.uint32)
            at = place[ranks]
            n, first = size[at], start[at]
            run = np.cumsum(n) - n
            tokens = flat[np.repeat(first - run, n) + np.arange(int(n.sum()))]
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(lengths)]
            doc_ids += [None if m else i for i, m in zip(ids.tolist(), missing.tolist(), strict=True)]
            offsets += (ends + offsets[-1]).tolist()
            values.append(tokens)
        tokens = pa.array(np.concatenate(empty + values).astype(np.int32))
        columns = {
            "doc_id": pa.array(doc_ids, pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens),
        }
        if table is not None:
            columns["decoded"] = _bytes_of(columns["ids"], table.value)
        release()
        return pa.table(columns)

    return assemble


def encode(
    documents: DataFrame, path: str, pattern: str, chunk_chars: int | None = None, decoded: bool = False
) -> DataFrame:
    """doc_id and the token ids of each document's whole text, in order; with ``decoded`` their bytes as well."""
    spark = documents.sparkSession
    parts = partitions(spark)
    buckets = RANGES_PER_PARTITION * parts
    chunk_chars = chunk_chars or min(MOST_CHUNK_CHARS, max(CHUNK_CHARS, CHARS_PER_RANGE * buckets))
    # One vocabulary: its size does not follow the corpus.
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    table = spark.sparkContext.broadcast(token_table(path)) if decoded else None
    chunks = (
        documents.select("doc_id", "text")
        .mapInArrow(_split(pattern, buckets, chunk_chars), _ROUTED)
        .repartition(parts, "route")
    )
    replies = chunks.groupBy("route").applyInArrow(_encode(ranks, pattern, buckets), _ROUTED)
    schema = "doc_id bigint, ids array<int>" + (", decoded binary" if decoded else "")
    return chunks.groupBy("route").cogroup(replies.groupBy("route")).applyInArrow(_assemble(table), schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (doc_id, ids) with the bytes of each document, by the table of token bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(token_table(path))  # as large as the vocabulary

    @F.arrow_udf("binary")
    def joined(ids: pa.Array) -> pa.Array:
        return _bytes_of(ids, shared.value)

    return tokens.withColumn("decoded", joined("ids"))


def token_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, and SHA-256 of its decimal ids and of its decoded bytes."""
    return encode(documents, path, pattern, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
