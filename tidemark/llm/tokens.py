"""Token ids in Parquet: list columns with dictionary or delta encoding, bounded row groups, and page indexes.

A dataset is a folder with two tables. ``tokens`` has one file for each part of the doc_id order, its rows in that order:
part, at (ids before the document in its part), doc_id, n_tokens and ids. ``parts`` has one row for each part: how many
documents and ids it has, and how many ids come before it. So a document's place among all ids is known without a pass
over the ids, and a file can be written without knowing the files before it.

Spark's own writer makes the files, so a lost executor or a repeated task leaves no half file. Writer options bound the
row groups and pages and choose the encodings: ids by dictionary (or delta), all whole numbers beside them by delta.
Pages carry minima and maxima, rows are ordered, and the ids are a column of their own: a read of metadata takes no byte
of the ids, a read of a range of documents or of ids takes the pages it needs.

Texts are cut into units that no pre-token crosses, at white space and after a word of Latin letters, and a task encodes
each distinct unit once while its table of units has room. Such a word is one pre-token: new ones go to the tokenizer's
model some hundreds at a time, with a byte between them that its merges do not know. Other units go to the tokenizer as it
is. Texts with white space beyond blank, tab and line ends are encoded as one unit. The ids are shuffled, two bytes each
where the vocabulary allows; texts are not.

Defined results: null and empty texts have the end id alone; null doc_ids come first; rows with one doc_id are in the
order of a hash of their texts; repeated rows are each written; a very long text is one row, and its ids are one list of
it; an empty table makes an empty dataset; other columns are neither read nor written.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from tidemark.llm.common import partitions, release, shared_dir
from tidemark.llm.ordered import cell_bounds, slices

#: Id that ends each document.
END = 0
#: Bytes of a row group and of a page, and rows of a page at most.
GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 64 << 10, 2000
#: Distinct units that a worker keeps the ids of, in two halves: a full half takes the place of the older one.
KNOWN_UNITS = 600_000
#: Words that the model gets at a time.
WORDS_AT_ONCE = 400

#: Latin letters with the blank before them.
_WORD = r" ?[A-Za-zÀ-ÖØ-öø-ɏ]++"
#: Such a word before ASCII other than letters (or at the end), anything up to white space with the blank before it, white
#: space up to the last before a word, or that last one.
_UNIT = _WORD + r"(?![^\x00-@\[-`{-\x7f])| ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]"
#: White space of other kinds, which units must not cut.
_OTHER_SPACE = r"[^\S \t\n\r]|[\x1c-\x1f\x85᠎​﻿]"

_PACKED = "part int, order_id bigint, tie bigint, doc_id bigint, packed binary"
_ROWS = "part int, at bigint, doc_id bigint, n_tokens bigint, ids array<int>"


@lru_cache(maxsize=1)
def _tokenizer(model: Broadcast) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread; others would keep memory of their own
    tokenizer = Tokenizer.from_str(model.value)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def _byte_letters() -> np.ndarray:
    """The letter that byte-level tokenizers write for each byte, as UTF-16 units."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return np.array([b if b in shown else next(rest) for b in range(256)], "<u2")


class WordEncoder:
    """Ids of words of letters, each a pre-token, by the tokenizer's own model, many at a time."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.letters, self.words = _byte_letters(), Tokenizer(tokenizer.model)
        self.between = tokenizer.token_to_id(chr(self.letters[0]))

    @staticmethod
    def fits(tokenizer: Tokenizer) -> bool:
        """Does the tokenizer cut and merge in the way that is relied on?"""
        model, cut = tokenizer.model, tokenizer.pre_tokenizer
        if not isinstance(model, BPE) or not isinstance(cut, ByteLevel) or tokenizer.normalizer is not None:
            return False
        plain = not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges)
        own = all(t.special for t in tokenizer.get_added_tokens_decoder().values()) and tokenizer.encode_special_tokens
        zero = chr(_byte_letters()[0])
        alone = [t for t in tokenizer.get_vocab(with_added_tokens=False) if zero in t] == [zero]
        whole = tokenizer.truncation is None and tokenizer.padding is None
        return plain and own and alone and whole and cut.use_regex and not cut.add_prefix_space

    def encode(self, words: list[str], kind: str) -> Iterator[bytes]:
        for k in range(0, len(words), WORDS_AT_ONCE):
            joined = "\0".join([*words[k : k + WORDS_AT_ONCE], ""]).encode()
            shown = self.letters[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.words.encode_batch_fast([shown], add_special_tokens=False)[0].ids, kind)
            packed, size, start = ids.tobytes(), ids.itemsize, 0
            for end in (np.flatnonzero(ids == self.between) * size).tolist():
                yield packed[start:end]
                start = end + size


class Units(dict):
    """Ids of units; one that is not there is taken from the older half, or gets an empty place that is to be filled."""

    def __init__(self, older: dict[str, bytes]) -> None:
        super().__init__()
        self.older, self.places = older, {}

    def __missing__(self, unit: str) -> bytes | bytearray:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.places[unit] = bytearray()
        self[unit] = ids
        return ids


class UnitEncoder:
    """Ids of texts as little-endian bytes; each distinct unit is encoded once while the table has room."""

    def __init__(self, tokenizer: Tokenizer, most: int = KNOWN_UNITS) -> None:
        self.tokenizer, self.most, self.known, self.growth = tokenizer, most, Units({}), 0
        self.kind = "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.find, self.odd = re.compile(_UNIT).findall, re.compile(_OTHER_SPACE).search
        self.words, self.word = WordEncoder(tokenizer) if WordEncoder.fits(tokenizer) else None, re.compile(_WORD).fullmatch

    @property
    def older(self) -> dict[str, bytes]:
        return self.known.older

    def encode(self, texts: list[str]) -> list[bytes]:
        before = len(self.known)
        if before + self.growth > self.most // 2:
            self.known.older = {}
            self.known, before = Units(self.known), 0
        known, look = self.known, self.known.__getitem__
        found = [list(map(look, self.find(t))) for t in texts]  # one look for each unit: looks are what costs
        self.growth, places, known.places = len(known) - before, known.places, {}
        words = [u for u in places if self.word(u)] if self.words else []
        others = [u for u in places if not self.word(u)] if self.words else list(places)
        odd = {u for u in others if self.odd(u)}  # not kept, so they are met here each time
        others = [u for u in others if u not in odd]
        for units, encoded in ((words, self.words.encode(words, self.kind) if words else ()), (others, self._plain(others))):
            for unit, ids in zip(units, encoded, strict=True):
                places[unit] += ids
                known[unit] = ids
        for unit in odd:
            del known[unit]
        if not odd:
            return list(map(b"".join, found))
        return [self._plain([t])[0] if not odd.isdisjoint(self.find(t)) else b"".join(cut) for t, cut in zip(texts, found, strict=True)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def _encoder(model: Broadcast) -> UnitEncoder:
    return UnitEncoder(_tokenizer(model))


def _encoded(model: Broadcast, lows: list[tuple[int, int]]):
    """Rows (order_id, tie, doc_id, text) with the part that they belong to and their ids, packed."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in slices(batches, 100):
            order, tie, _, texts = (batch.column(i).to_pylist() for i in range(4))
            part = [max(0, bisect.bisect_right(lows, key) - 1) for key in zip(order, tie, strict=True)]
            packed = pa.array(encoder.encode([t or "" for t in texts]), pa.binary())
            columns = [pa.array(part, pa.int32()), batch.column(0), batch.column(1), batch.column(2), packed]
            yield pa.RecordBatch.from_arrays(columns, ["part", "order_id", "tie", "doc_id", "packed"])
        release()

    return encode


def _unpacked(kind: str, end: int | None):
    """Ordered rows of a part with their ids as lists, the end id added, and their place in the part."""
    last = np.array([] if end is None else [end], np.int32)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in slices(batches, 200):
            part, doc_id = batch.column(0), batch.column(3)
            starts, sizes, lists = [], [], []
            for p, packed in zip(part.to_pylist(), batch.column(4).to_pylist(), strict=True):
                current, at = (p, at) if p == current else (p, 0)
                ids = np.concatenate([np.frombuffer(packed, kind).astype(np.int32), last])
                starts.append(at)
                sizes.append(len(ids))
                lists.append(ids)
                at += len(ids)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            values = pa.array(np.concatenate([np.empty(0, np.int32), *lists]), pa.int32())
            columns = [part, pa.array(starts, pa.int64()), doc_id, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "at", "doc_id", "n_tokens", "ids"])
        release()

    return unpack


def _options(encoding: str, group_bytes: int, page_bytes: int, page_rows: int) -> dict[str, str]:
    dictionary = {"dictionary": "true", "delta": "false"}[encoding]
    return {
        "parquet.writer.version": "PARQUET_2_0",  # whole numbers without a dictionary are written as deltas
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": dictionary,
        "parquet.block.size": str(group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.page.size.row.check.min": "8",  # rows differ in size: groups and pages are measured early and often
        "parquet.page.size.row.check.max": "64",
        "compression": "zstd",
    }


def write_tokens(
    documents: DataFrame,
    tokenizer: str,
    path: str,
    end: int | None = END,
    encoding: str = "dictionary",
    group_bytes: int = GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
    parts: int | None = None,
) -> str:
    """Write the dataset of ``documents`` (doc_id, text) by the tokenizer file to the new folder ``path``.

    To the driver come two whole numbers for each part, where parts begin; they go out with the tasks.
    """
    spark = documents.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        model = file.read()
    kind = UnitEncoder(Tokenizer.from_str(model)).kind
    order_id = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order_id")
    keyed = documents.select(order_id, F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "doc_id", "text")
    _, lows = cell_bounds(keyed.select("order_id", "tie"), parts or partitions(spark))
    rows = keyed.mapInArrow(_encoded(spark.sparkContext.broadcast(model), lows), _PACKED)
    ordered = rows.repartitionById(max(1, len(lows)), F.col("part")).sortWithinPartitions("part", "order_id", "tie")
    written = ordered.mapInArrow(_unpacked(kind, end), _ROWS)
    written.write.options(**_options(encoding, group_bytes, page_bytes, page_rows)).parquet(f"{path}/tokens")
    sums = (
        spark.read.schema(_ROWS).parquet(f"{path}/tokens")
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    sums.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")
    return path


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """part, documents, tokens, first_id, last_id and start of each part."""
    return spark.read.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids, of the documents from ``first_id`` to ``last_id`` where these are given.

    Columns that are not used are not read, and pages without such documents are passed over.
    """
    rows = spark.read.schema(_ROWS).parquet(f"{path}/tokens")
    for given, keep in ((first_id, F.col("doc_id") >= F.lit(first_id)), (last_id, F.col("doc_id") <= F.lit(last_id))):
        rows = rows if given is None else rows.filter(keep)
    starts = read_parts(spark, path).select("part", F.col("start").alias("part_start"))
    return rows.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_window(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """The documents with ids among those numbered from ``begin`` to ``end`` (exclusive), cut to them.

    Only files of parts that the window meets are scanned, by the bounds of their pages.
    """
    met = read_parts(spark, path).filter((F.col("start") < end) & (F.col("start") + F.col("tokens") > begin))
    edge = met.agg(F.min("part").alias("first"), F.max("part").alias("last")).first()
    if edge.first is None:
        return read_tokens(spark, path).limit(0)
    rows = spark.read.schema(_ROWS).parquet(f"{path}/tokens").filter(F.col("part").between(edge["first"], edge["last"]))
    start = F.col("part_start") + F.col("at")
    found = rows.join(met.select("part", F.col("start").alias("part_start")), "part").withColumn("start", start)
    found = found.filter((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin))
    low = F.greatest(F.lit(begin) - F.col("start"), F.lit(0))
    high = F.least(F.lit(end) - F.col("start"), F.col("n_tokens"))
    cut = F.slice("ids", (low + 1).cast("int"), (high - low).cast("int"))
    return found.select("doc_id", (F.col("start") + low).alias("start"), (high - low).alias("n_tokens"), cut.alias("ids"))


def ids_crc32(ids: Column) -> Column:
    """CRC-32 of each list's ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("bigint")
    def computed(lists: pa.Array) -> pa.Array:
        values, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_pylist()
        return pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())

    return computed(ids)


def token_file_digests(documents: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """One row for each document, read back from the dataset: doc_id, start, n_tokens and ids_crc32."""
    spark = documents.sparkSession
    path = write_tokens(documents, tokenizer, path or shared_dir(spark))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", ids_crc32(F.col("ids")).alias("ids_crc32"))
