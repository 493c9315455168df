"""Periodic runs of words: stretches that repeat themselves, found from Lyndon words and collapsed to one period.

A run is a stretch of words with smallest period q and at least two periods that no neighbouring word extends. In the
order of words or in its reverse, every run has a period that is the longest Lyndon word at its first place. Texts are
scanned right to left, once under each order, with a stack of Lyndon words: the word at a place takes in the words after
it while it is smaller than they are. Suffixes are compared, and candidates extended to both sides, by the longest
common extension: some words are compared one by one, then rolling hashes by galloping and binary search. What is
reported is verified on the words themselves. There is no suffix array.

A text is scanned where it is read, in n log n steps; nothing is shuffled.

Defined results: null and empty texts have no words and no runs; a very long text is scanned whole, in memory that
grows with its words; repeated rows are scanned alike; an empty table gives an empty result; other columns are neither
read nor returned. A null doc_id is kept, and its text is left as it is by ``planted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, release
from tidemark.llm.ordered import slices

#: Words of the shortest run that is reported.
LEAST = 12
#: Words that are compared one by one before hashes are.
DIRECT = 8
#: Modulus and base of the rolling hash.
PRIME, BASE = (1 << 61) - 1, 911_382_323_000_003

Run = tuple[int, int, int]

_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string()),
    ]
)
_DDL = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class _Words:
    """Words as numbers, with how far two places agree to the right and to the left."""

    def __init__(self, ids: list[int]) -> None:
        self.ids, self.n = ids, len(ids)
        self.sums: list[int] = []
        self.powers: list[int] = []

    def _same(self, i: int, j: int, k: int) -> bool:
        if not self.sums:  # most texts never get here
            sums, powers, h, p = [0], [1], 0, 1
            for x in self.ids:
                h, p = (h * BASE + x + 1) % PRIME, p * BASE % PRIME
                sums.append(h)
                powers.append(p)
            self.sums, self.powers = sums, powers
        sums, p = self.sums, self.powers[k]
        return (sums[i + k] - sums[i] * p - sums[j + k] + sums[j] * p) % PRIME == 0

    def _reach(self, most: int, same) -> int:
        """The greatest k up to ``most`` for which ``same(k)``, known to hold for ``DIRECT``."""
        low, high = DIRECT, 2 * DIRECT
        while high <= most and same(high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            if same(middle):
                low = middle
            else:
                high = middle
        return low

    def right(self, i: int, j: int) -> int:
        """How many words from ``i`` on equal those from ``j`` > ``i`` on."""
        ids, most = self.ids, self.n - j
        for k in range(min(DIRECT, most)):
            if ids[i + k] != ids[j + k]:
                return k
        return most if most <= DIRECT else self._reach(most, lambda k: self._same(i, j, k))

    def left(self, i: int, j: int) -> int:
        """How many words before ``i`` equal those before ``j`` > ``i``."""
        ids = self.ids
        for k in range(min(DIRECT, i)):
            if ids[i - 1 - k] != ids[j - 1 - k]:
                return k
        return i if i <= DIRECT else self._reach(i, lambda k: self._same(i - k, j - k, k))

    def lyndon_ends(self, sign: int) -> list[int]:
        """Where the longest Lyndon word at each place ends, words being ordered by number times ``sign``.

        The ends are the stack: the word that starts where one ends lies below it.
        """
        n, right = self.n, self.right
        w = self.ids if sign > 0 else [-x for x in self.ids]
        ends = [0] * n
        for i in range(n - 1, -1, -1):
            j, first = i + 1, w[i]
            while j < n:
                other = w[j]
                if first == other:
                    k = right(i, j)
                    if j + k == n or w[i + k] > w[j + k]:
                        break
                elif first > other:
                    break
                j = ends[j]
            ends[i] = j
        return ends


def _verified(words: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The ends of the run by the words themselves; they differ from those given only where hashes have collided."""
    n = len(words)
    agrees = bool((words[start : end - period] == words[start + period : end]).all())
    if agrees and (not start or words[start - 1] != words[start + period - 1]) and (end == n or words[end] != words[end - period]):
        return start, end
    places = np.flatnonzero(words[:-period] != words[period:])
    at = int(np.searchsorted(places, (start + end - period) // 2))
    return (int(places[at - 1]) + 1 if at else 0), (int(places[at]) if at < len(places) else n - period) + period


def find_runs(ids: list[int], least: int = LEAST) -> list[Run]:
    """(start, length, period) of each run of at least ``least`` words, by start, then period."""
    n = len(ids)
    if n < max(least, 2):
        return []
    text = _Words(ids)
    words = np.array(ids, np.int64)
    # A run has enough words for which the word a period on is the same that some neighbouring ones, right or left of
    # its Lyndon word, agree: half of those it has.
    some = max(1, min(3, least // 4))
    padded = np.concatenate([np.full(some, -2), words, np.full(some, -1)])
    found: set[Run] = set()
    for sign in (1, -1):
        ends = np.array(text.lyndon_ends(sign), np.int64)
        at = np.arange(n)
        after, before = np.ones(n, bool), np.ones(n, bool)
        for k in range(some):
            after &= padded[some + at + k] == padded[np.minimum(some + ends + k, n + 2 * some - 1)]
            before &= padded[some + at - 1 - k] == padded[some + ends - 1 - k]
        known: dict[int, tuple[int, int]] = {}
        likely = np.flatnonzero(after | before)
        for i, j in zip(likely.tolist(), ends[likely].tolist(), strict=True):
            period = j - i
            if period in known and known[period][0] <= i and j <= known[period][1]:
                continue
            start, end = i - text.left(i, j), j + text.right(i, j)
            if end - start >= max(least, 2 * period):
                start, end = _verified(words, start, end, period)
                known[period] = start, end
                if end - start >= max(least, 2 * period):
                    found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run has after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    if not runs:
        return words
    return [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]


def periodic_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, the runs of each text, and the text with every run collapsed to its first period."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD_PATTERN).findall
        for batch in slices(batches, 200):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = find(text or "")
                numbers: dict[str, int] = {}
                runs = find_runs([numbers.setdefault(w, len(numbers)) for w in words], least)
                named = [{"start": a, "length": b, "period": c} for a, b, c in runs]
                out.append({"doc_id": doc_id, "n_words": len(words), "runs": named, "collapsed": " ".join(kept_words(words, runs))})
            yield pa.RecordBatch.from_pylist(out, _OUT)
        release()

    return documents.select("doc_id", "text").mapInArrow(scanned, _DDL)


def planted(documents: DataFrame) -> DataFrame:
    """doc_id and text, with every tenth text by the hash of its doc_id made periodic from one of its words on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.call_function("div", h, F.lit(10))
    words = F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"))
    n = F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.call_function("div", n - a, 3 + g % 8)
    length = F.greatest(n - a, F.lit(0))
    times = F.ceil(length / p).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times))
    whole = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), length.cast("int")))
    chosen = (h % 10 == 0) & F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    return documents.select("doc_id", F.when(chosen, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def _longest(runs: Column) -> Column:
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))


def run_digests(documents: DataFrame) -> DataFrame:
    """One row for each document, some of which are made periodic first: its runs in short, and digests of all."""
    found = periodic_runs(planted(documents)).withColumn("longest", _longest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.n").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.call_function("div", F.col("longest.n") * 1000, -F.col("longest.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
