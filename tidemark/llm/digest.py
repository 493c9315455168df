"""Quartile bucket digests: a fingerprint that changes little when a text changes little.

Every three neighbouring bytes of the UTF-8 text are hashed to one of 256 buckets. The digest states for each
bucket in which quartile of the counts it lies (two bits) and, in its first byte, the logarithm of the text's
length. Two digests differ by the sum of their quartile steps, a step over all quartiles counting double, and of
their length steps; the sum is bounded by what unrelated texts reach, so the likeness runs from 0 to 1.

Defined results: null is the empty text; texts under three bytes have no triplets and all buckets in the lowest
quartile; equal texts have equal digests; a very long text is counted whole, in parts; after the last document comes the first, so a single document follows
itself; rows without a doc_id come first, rows with the same doc_id are ordered by text; an empty table gives an
empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, texts_of
from tidemark.llm.ordered import cell_bounds, in_order, walk, with_cells

BUCKETS = 256
#: Steps of the length code in a doubling, and the most that lengths add to a difference.
LENGTH_STEPS, MOST_LENGTH = 8, 24
#: Cost of 0, 1, 2 and 3 quartile steps.
STEP_COST = np.array([0, 1, 2, 6], np.int64)
#: Mean cost of unrelated digests; differences are bounded by it.
MOST_DIFFERENCE = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) // 16

_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def triplet_counts(data: bytes) -> np.ndarray:
    """How many byte triplets fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for lo in range(0, max(0, len(raw) - 2), 1 << 18):  # parts overlap by two bytes
        b = raw[lo : lo + (1 << 18) + 2].astype(np.uint32)
        mixed = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        counts += np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> bytes:
    counts = triplet_counts(data)
    ranked = np.sort(counts)
    marks = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > marks[None, :]).sum(axis=1).astype(np.uint8)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return bytes([min(255, round(LENGTH_STEPS * math.log2(1 + len(data))))]) + packed.astype(np.uint8).tobytes()


def _codes(print_: bytes) -> np.ndarray:
    packed = np.frombuffer(print_, np.uint8, offset=1)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel().astype(np.int64)


def difference(a: bytes, b: bytes) -> int:
    """0 for equal digests, at most ``MOST_DIFFERENCE``."""
    steps = int(STEP_COST[np.abs(_codes(a) - _codes(b))].sum())
    return min(MOST_DIFFERENCE, steps + min(MOST_LENGTH, abs(a[0] - b[0])))


def likeness(a: bytes, b: bytes) -> float:
    return 1 - difference(a, b) / MOST_DIFFERENCE


def fingerprints(text: Column) -> Column:
    """Digests of a text column, as hexadecimal digits."""

    @F.arrow_udf("string")
    def computed(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.encode()).hex() for t in texts_of(texts)], pa.string())

    return computed(text)


def _compare(row: dict, follower: dict | None) -> dict:
    text, after = row["text"] or "", (follower or {}).get("text") or ""
    half = len(text) // 2
    edited = (text[: len(text) - half] + after[:half]).encode()
    for r, t in ((row, text), (follower, after)):
        if r is not None and "print" not in r:  # the follower is the next row: its digest is kept
            r["print"] = fingerprint(t.encode())
    own, changed = row["print"], fingerprint(edited)
    return {
        "doc_id": row["doc_id"],
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited).hexdigest(),
        "fingerprint": own.hex(),
        "edited_fingerprint": changed.hex(),
        "near_edited": likeness(own, changed),
        "near_next": likeness(own, follower["print"] if follower else fingerprint(b"")),
    }


def compare_with_next(documents: DataFrame) -> DataFrame:
    """Each document's digest beside those of the next document and of the text whose tail is the next one's head."""
    spark = documents.sparkSession
    parts = partitions(spark)
    at = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at")
    highs, lows = cell_bounds(documents.select(at), parts)
    rows = with_cells(documents.select(at, "doc_id", "text"), ["at"], highs, lows, wrap=True)
    fields = ["doc_id", "text", "cell", "halo"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return walk(batches, _compare, fields, _OUT, 2000)

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return in_order(rows, ["at", "text"], parts).mapInArrow(compared, schema)
