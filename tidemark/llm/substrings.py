"""Exact substring deduplication by interval expansion on a Burrows-Wheeler transform.

Every byte that lies in a string of ``LEAST`` bytes which also starts in a document with a smaller doc_id is removed.
Texts are UTF-8 bytes and matches never cross documents.

The suffixes of a whole corpus cannot be sorted in one place, and need not be: equal strings have equal minimizers,
the least hashed ``GRAM``-byte strings of each window. So

0. texts that a smaller doc_id has as well are found by digest: all their strings are in that copy, and no other
   document needs theirs, so they take no part in what follows and are cut whole;
1. documents are dealt to cells by doc_id, and each cell sends the distinct minimizer hashes of its texts, packed by
   hash range, with a mark where two of its documents have one;
2. a range tells each cell which of its hashes two or more documents of the corpus have;
3. a cell sends the text around those minimizers as fragments, each once with the smallest doc_id that has it, to the
   range of the minimizer's hash, so all strings of ``LEAST`` bytes that begin under it meet there;
4. a range builds the transform of its distinct fragments (copies are one, and a minimizer with one fragment needs
   none) and expands intervals by backward extension, breadth first: level d splits the suffixes by their first d
   bytes, so the boundaries that appear at level d + 1 are the common prefixes of length d. At ``LEAST`` it stops: what is still one interval is one string, and its smallest doc_id is known;
5. each cell gets the places at which its fragments have a smaller doc_id, and cuts its documents.

A passage that every document has costs one fragment a cell. Cells and ranges follow the corpus, each keeping its size.

Defined results: null and empty texts have nothing to remove; rows with equal doc_ids, whether their texts are equal or
not, are occurrences in the same document, so neither removes from the other, and each is cut by itself; a null doc_id
is smaller than all; a very long text is one row of its cell and is cut whole, a task holds the cell it is working on;
an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions

LEAST = 50
#: Bytes of a minimizer, and how many of them begin in a window of ``LEAST`` bytes.
GRAM = 16
SPAN = LEAST - GRAM + 1
#: Bytes of text in a cell, about: the least, the most, and those for each range of hashes between them, so that what a
#: cell sends to a range is worth a row when ranges grow with the corpus. Ranges for each shuffle partition.
CELL_BYTES, MOST_CELL_BYTES, BYTES_PER_RANGE = 4 << 20, 64 << 20, 1024
RANGES_PER_PARTITION = 4
#: Bytes of fragments that are put into one transform, so that it fits a core's cache; fragments of one minimizer are
#: never divided.
TRANSFORM_BYTES = 160 << 10
#: Keys that the copies of one text are spread over.
SALTS = 16

NO_DOC = -(1 << 63)
#: Kinds of replies to a cell.
SHARED, CUTS, COPIES = 0, 1, 2
_U = np.uint64


# --- minimizers ----------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place on."""
    h = (data.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
    step = 1
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        h = h[:-step] * _U(factor) + h[step:]
        step *= 2
    h ^= h >> _U(32)
    h *= _U(0xE7037ED1A0B428DB)
    h ^= h >> _U(29)
    return h


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values, by doubling."""
    done, step = values, 1
    while step * 2 <= width:
        done = pick(done[:-step], done[step:])
        step *= 2
    rest = width - step
    return pick(done[: len(done) - rest], done[rest:]) if rest else done


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the minimizers of a text, and their hashes; every window's least hash is among them, ties all."""
    if len(data) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = gram_hashes(data)
    least = _sliding(hashes, SPAN, np.minimum)  # for each window
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    greatest = _sliding(padded, SPAN, np.maximum)  # the greatest minimum of the windows that hold a place
    places = np.flatnonzero(hashes == greatest)
    return places, hashes[places]


def window_reach(data_len: int, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start for which each minimizer is the leftmost least one.

    Hashes of the other places in a window are greater, so only minimizers compete.
    """
    n = len(places)
    low, high = np.maximum(places - SPAN + 1, 0), np.minimum(places, data_len - LEAST)
    for shift in range(1, SPAN):
        if shift >= n:
            break
        gap = places[shift:] - places[:-shift]
        if gap.min(initial=SPAN) >= SPAN:
            break
        near = gap < SPAN
        left, right = hashes[:-shift], hashes[shift:]
        # an earlier place with a hash no greater wins in every window that holds it
        beaten = near & (left <= right)
        low[shift:] = np.where(beaten, np.maximum(low[shift:], places[:-shift] + 1), low[shift:])
        beaten = near & (right < left)
        high[:-shift] = np.where(beaten, np.minimum(high[:-shift], places[shift:] - SPAN), high[:-shift])
    return low, high


# --- the transform -------------------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first ``depth`` symbols, by doubling from eight."""
    n = len(text)
    wide = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << _U(8) | wide[i : i + n]
    order = np.argsort(key)
    reach = 8
    while reach < depth:
        ranked = key[order]
        rank = np.empty(n + reach, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])).astype(np.uint64) + _U(1)
        rank[n:] = 0
        key = rank[:n] << _U(32) | rank[reach : reach + n]
        order = np.argsort(key)
        reach *= 2
    return order


def transform(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward steps of the Burrows-Wheeler transform, and their inverse.

    Row q of the transform holds the symbol before the suffix of row q, and ``back[q]`` is the row of the suffix with
    that symbol put before it: the symbols less than it, and those equal to it in rows before q, counted. The last
    symbol of ``text`` is the least suffix and takes the row before all others.
    """
    n = len(text)
    before = text[order - 1].astype(np.int16)
    before[np.flatnonzero(order == 0)] = -1
    ahead = np.argsort(before, kind="stable").astype(np.int32)
    back = np.empty(n, np.int32)
    back[ahead] = np.arange(n, dtype=np.int32)
    return back, ahead


def interval_starts(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Where intervals of suffixes with equal first ``least`` bytes begin in ``order``.

    A queue holds intervals [low, high) of strings of one length, at first that of the empty string. Each is extended
    backward by every symbol in its rows of the transform; where the end of an extension has no boundary yet, the common
    prefix there is as long as the string was, and the extension is queued. Ends that have one need no more: whatever
    they lead to is known. So common prefixes come out by increasing length, and the queue is dropped at ``least``.
    """
    n = len(order)
    back, ahead = transform(text, order)
    symbols = np.append(text[order].astype(np.int16), -2)  # first symbols of the rows, in order
    symbols[0] = -1
    turns = symbols[1:] != symbols[:-1]
    after, prior = np.append(ahead[1:], n), np.append(-1, ahead[:-1])  # the next and last row with the symbol of a step
    after[turns], prior[1:][turns[:-1]] = n, -1
    starts = np.zeros(n + 1, bool)
    starts[[0, n]] = True
    ends = np.zeros((2, n), bool)
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(least):
        if not len(low):
            break
        sizes = high - low
        rows = _gather(low, sizes)
        step = back[rows]
        # The rows of an interval with one symbol lead to rows that follow each other: the first and last are its ends.
        ends[:] = False
        ends[0, step[prior[step] < np.repeat(low, sizes)]] = True
        ends[1, step[after[step] >= np.repeat(high, sizes)]] = True
        low, high = np.flatnonzero(ends[0]), np.flatnonzero(ends[1]) + 1
        fresh = ~starts[high]
        starts[high] = True
        low, high = low[fresh], high[fresh]
    return starts[:n]


# --- packing -------------------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    return zstandard.compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def _unpack(block: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(block)
    sizes = np.frombuffer(raw, np.int64, len(kinds), 8).tolist()
    at, out = 8 * (len(kinds) + 1), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_ROUTED = "route bigint, cell bigint, body binary"


def _routed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["route", "cell", "body"])


def _by_range(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the hashes by range, and where each range begins."""
    place = (hashes >> _U(8)) % _U(ranges)
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(ranges + 1, dtype=np.uint64))


# --- steps ---------------------------------------------------------------------------------------------------------


def _documents(group: pa.Table, replies: pa.Table) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(doc_id, bytes, is a copy) of a cell's rows, smallest doc_id first."""
    copies: dict[int, set[bytes]] = {}
    for ids, digests in (_unpack(b, np.int64, np.dtype("V16")) for b in _bodies(replies, COPIES)):
        for doc, digest in zip(ids.tolist(), digests.tolist(), strict=True):
            copies.setdefault(doc, set()).add(digest)
    ids, texts = group.column("doc_id").to_pylist(), group.column("text").combine_chunks()
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        text = texts[i].as_buffer()
        data = np.frombuffer(text, np.uint8) if text is not None else np.empty(0, np.uint8)
        yield ids[i], data, ids[i] in copies and hashlib.md5(data).digest() in copies[ids[i]]


def _bodies(replies: pa.Table, kind: int) -> list[bytes]:
    kinds = replies.column("kind").to_pylist()
    return [b.as_py() for b, k in zip(replies.column("body"), kinds, strict=True) if k == kind]


def _pack_copies(group: pa.Table) -> pa.Table:
    digests = np.frombuffer(b"".join(group.column("digest").to_pylist()), np.dtype("V16"))
    body = _pack(group.column("doc_id").to_numpy(), digests)
    return pa.table({"cell": pa.array([group.column("cell")[0].as_py()]), "body": pa.array([body], pa.binary())})


def _send_hashes(ranges: int):
    """A cell's distinct minimizer hashes by range, with a mark where two of its documents have one."""

    def send(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _routed([])
        found = [np.empty(0, np.uint64)]
        for _, data, copy in _documents(group, replies):
            if copy:
                continue
            own = np.unique(minimizers(data)[1])
            found.append(own)
        hashes = np.concatenate(found)
        own, counts = np.unique(hashes, return_counts=True)
        order, edges = _by_range(own, ranges)
        own, twice = own[order], (counts[order] > 1).astype(np.uint8)
        cell = group.column("cell")[0].as_py()
        spans = [(r, edges[r], edges[r + 1]) for r in np.flatnonzero(np.diff(edges)).tolist()]
        return _routed([(r, cell, _pack(own[a:b], twice[a:b])) for r, a, b in spans])

    return send


def _find_shared(group: pa.Table) -> pa.Table:
    """Which hashes of a range two documents have: to each cell its own, by cell."""
    cells = group.column("cell").to_pylist()
    blocks = [_unpack(b, np.uint64, np.uint8) for b in group.column("body").to_pylist()]
    if not blocks:
        return _routed([])
    hashes = np.concatenate([h for h, _ in blocks])
    twice = np.concatenate([t for _, t in blocks])
    values, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[inverse[twice > 0]] = True
    out, at = [], 0
    for cell, (own, _) in zip(cells, blocks, strict=True):
        kept = own[shared[inverse[at : at + len(own)]]]
        at += len(own)
        if len(kept):
            out.append((cell, cell, _pack(kept)))
    return _routed(out)


def _shared_hashes(replies: pa.Table) -> np.ndarray:
    blocks = [_unpack(b, np.uint64)[0] for b in _bodies(replies, SHARED)]
    return np.unique(np.concatenate([np.empty(0, np.uint64), *blocks]))


def _fragments(data: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window start of each shared minimizer of a text."""
    places, hashes = minimizers(data)
    if not len(places) or not len(shared):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = window_reach(len(data), places, hashes)
    at = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
    kept = (shared[at] == hashes) & (low <= high)
    return hashes[kept], low[kept], high[kept]


class _Fragments:
    """The distinct fragments of a cell in order of first sight; documents come smallest doc_id first."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.hashes: list[int] = []
        self.docs: list[int] = []

    def visit(self, doc: int, data: np.ndarray, shared: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Numbers of a document's fragments, and their window starts."""
        hashes, low, high = _fragments(data, shared)
        raw, numbers = data.tobytes(), []
        for h, a, b in zip(hashes.tolist(), low.tolist(), (high + LEAST).tolist(), strict=True):
            number = self.index.setdefault(raw[a:b], len(self.hashes))
            if number == len(self.hashes):
                self.hashes.append(h)
                self.docs.append(doc)
            numbers.append(number)
        return numbers, low, high


def _send_fragments(ranges: int):
    """A cell's distinct fragments around shared minimizers, by range, each with the smallest doc_id that has it."""

    def send(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows or not replies.num_rows:
            return _routed([])
        shared, found = _shared_hashes(replies), _Fragments()
        for doc, data, copy in _documents(group, replies):
            if not copy:
                found.visit(doc, data, shared)
        hashes, docs, texts = np.array(found.hashes, np.uint64), np.array(found.docs, np.int64), list(found.index)
        order, edges = _by_range(hashes, ranges)
        cell, out = group.column("cell")[0].as_py(), []
        for r in np.flatnonzero(np.diff(edges)).tolist():
            mine = order[edges[r] : edges[r + 1]]
            picked = [texts[i] for i in mine.tolist()]
            lengths = np.fromiter(map(len, picked), np.int32, len(picked))
            body = np.frombuffer(b"".join(picked), np.uint8)
            out.append((r, cell, _pack(hashes[mine], docs[mine], mine.astype(np.int32), lengths, body)))
        return _routed(out)

    return send


def _least_docs(texts: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each place of the joined fragments the smallest doc_id that has the ``LEAST`` bytes from there on.

    The greatest integer where so many bytes do not follow in the fragment.
    """
    ends = np.cumsum(lengths)
    text = np.zeros(int(lengths.sum()) + len(lengths), np.uint8)  # a zero after each fragment
    owner = np.repeat(np.arange(len(lengths)), lengths)
    where = np.arange(len(texts)) + owner
    text[where] = texts + np.uint8(1)  # UTF-8 has no byte 255
    order = suffix_order(text, LEAST)
    starts = interval_starts(text, order, LEAST)
    place = np.full(len(text), -1, np.int64)
    offset = np.arange(len(texts)) - (ends - lengths)[owner]
    whole = offset + LEAST <= lengths[owner]
    place[where[whole]] = np.flatnonzero(whole)
    rows = place[order]
    taken = rows >= 0
    rows, interval = rows[taken], np.cumsum(starts)[taken]
    least = np.full(len(texts), np.iinfo(np.int64).max)
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        smallest = np.minimum.reduceat(docs[owner[rows]], first)
        least[rows] = np.repeat(smallest, np.diff(np.append(first, len(rows))))
    return least


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after the other."""
    run = np.cumsum(sizes) - sizes
    return np.repeat(starts - run, sizes) + np.arange(int(sizes.sum()))


def _expand(group: pa.Table) -> pa.Table:
    """Windows to cut in the fragments of a range: to each cell, its fragments' numbers and their marked windows."""
    cells = group.column("cell").to_pylist()
    blocks = [_unpack(b, np.uint64, np.int64, np.int32, np.int32, np.uint8) for b in group.column("body").to_pylist()]
    if not blocks:
        return _routed([])
    # Distinct fragments, each with the smallest doc_id of all cells.
    index: dict[bytes, int] = {}
    which, docs = [], np.concatenate([b[1] for b in blocks])
    for _, _, _, sizes, body in blocks:
        raw, ends = body.tobytes(), np.cumsum(sizes).tolist()
        which += [index.setdefault(raw[a:b], len(index)) for a, b in zip([0, *ends], ends, strict=False)]
    which = np.array(which, np.int64)
    texts = np.frombuffer(b"".join(index), np.uint8)
    lengths = np.fromiter(map(len, index), np.int64, len(index))
    begin = np.cumsum(lengths) - lengths
    hashes, smallest = np.empty(len(index), np.uint64), np.full(len(index), np.iinfo(np.int64).max)
    hashes[which] = np.concatenate([b[0] for b in blocks])
    np.minimum.at(smallest, which, docs)
    # Smallest doc_id of each window: that of the fragment where its minimizer has no other, else by the transform.
    least = np.repeat(smallest, lengths)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = np.diff(np.append(first, len(order)))
    minimizer = np.repeat(np.arange(len(first)), counts)
    several = np.repeat(counts > 1, counts)
    order, minimizer = order[several], minimizer[several]
    reach, at = np.cumsum(lengths[order]), 0
    while at < len(order):
        stop = int(np.searchsorted(reach, (reach[at - 1] if at else 0) + TRANSFORM_BYTES, side="left"))
        stop = int(np.searchsorted(minimizer, minimizer[min(stop, len(order) - 1)], side="right"))
        part = order[at:stop]
        places = _gather(begin[part], lengths[part])
        least[places] = _least_docs(texts[places], lengths[part], smallest[part])
        at = stop
    out, lo = [], 0
    for cell, (_, own, numbers, _, _) in zip(cells, blocks, strict=True):
        mine = which[lo : lo + len(own)]
        lo += len(own)
        windows = lengths[mine] - LEAST + 1
        marks = least[_gather(begin[mine], windows)] < np.repeat(own, windows)
        hit = np.maximum.reduceat(marks, np.cumsum(windows) - windows)
        if hit.any():
            kept = marks[np.repeat(hit, windows)]
            out.append((cell, cell, _pack(numbers[hit], windows[hit].astype(np.int32), np.packbits(kept))))
    return _routed(out)


def _marks(replies: pa.Table) -> dict[int, np.ndarray]:
    """Marked windows of each fragment of a cell that has any."""
    found = {}
    for block in _bodies(replies, CUTS):
        numbers, sizes, bits = _unpack(block, np.int32, np.int32, np.uint8)
        marks = np.unpackbits(bits, count=int(sizes.sum())).astype(bool)
        ends = np.cumsum(sizes).tolist()
        for number, a, b in zip(numbers.tolist(), [0, *ends], ends, strict=False):
            found[number] = marks[a:b]
    return found


def _cut_documents(group: pa.Table, replies: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """doc_id, bytes and the mark of each removed byte of a cell's documents."""
    shared, found, marks = _shared_hashes(replies), _Fragments(), _marks(replies)
    for doc, data, copy in _documents(group, replies):
        if copy:
            yield doc, data, np.full(len(data), len(data) >= LEAST)
            continue
        numbers, low, high = found.visit(doc, data, shared)
        starts = []
        for number, a, b in zip(numbers, low.tolist(), high.tolist(), strict=True):
            if found.docs[number] < doc:  # a smaller document of this cell has the whole fragment
                starts.append(np.arange(a, b + 1))
            elif number in marks:
                starts.append(a + np.flatnonzero(marks[number]))
        gone = np.zeros(len(data), bool)
        if starts:
            at = np.concatenate(starts)
            change = np.bincount(at, minlength=len(data) + 1) - np.bincount(at + LEAST, minlength=len(data) + 1)
            gone = np.cumsum(change)[: len(data)] > 0
        yield doc, data, gone


def _finish(group: pa.Table, replies: pa.Table) -> pa.Table:
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    columns: dict[str, list] = {n: [] for n in names}
    if group.num_rows:
        for doc, data, gone in _cut_documents(group, replies):
            columns["doc_id"].append(None if doc == NO_DOC else doc)
            columns["n_bytes"].append(len(data))
            columns["n_removed"].append(int(gone.sum()))
            columns["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            columns["kept"].append(data[~gone].tobytes())
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(columns[n], k) for n, k in zip(names, kinds, strict=True)], names)


def _copies(dealt: DataFrame) -> DataFrame:
    """(cell, body): doc_id and digest of each cell's documents whose text a smaller doc_id has.

    A digest that only one row has is out before the join, and each of the others meets its smallest doc_id under
    ``SALTS`` keys, so a large group of copies is not one task's.
    """
    digests = dealt.filter("text is not null").select("cell", "doc_id", F.unhex(F.md5("text")).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    gone = salted.join(spread, ["digest", "salt"]).filter("doc_id > first").select("cell", "doc_id", "digest")
    return gone.groupBy("cell").applyInArrow(_pack_copies, "cell bigint, body binary")


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans and ``kept``, the remaining bytes."""
    spark = documents.sparkSession
    parts = partitions(spark)
    ranges = RANGES_PER_PARTITION * parts
    total = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cells = max(1, -(-total // min(MOST_CELL_BYTES, max(CELL_BYTES, BYTES_PER_RANGE * ranges))))
    rows = documents.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(cells)).alias("cell"),
        F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc_id"),
        F.encode("text", "UTF-8").alias("text"),
    )
    dealt = rows.repartition(parts, "cell")
    by_cell = dealt.groupBy("cell")
    copies = _copies(rows).withColumn("kind", F.lit(COPIES)).repartition(parts, "cell")
    hashes = by_cell.cogroup(copies.groupBy("cell")).applyInArrow(_send_hashes(ranges), _ROUTED)
    shared = hashes.groupBy("route").applyInArrow(_find_shared, _ROUTED).select("cell", "body", F.lit(SHARED).alias("kind"))
    known = shared.unionByName(copies).repartition(parts, "cell")
    fragments = by_cell.cogroup(known.groupBy("cell")).applyInArrow(_send_fragments(ranges), _ROUTED)
    cuts = fragments.groupBy("route").applyInArrow(_expand, _ROUTED).select("cell", "body", F.lit(CUTS).alias("kind"))
    replies = known.unionByName(cuts)
    return by_cell.cogroup(replies.groupBy("cell")).applyInArrow(
        _finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )


def substring_digests(documents: DataFrame) -> DataFrame:
    found = dedup_substrings(documents)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
