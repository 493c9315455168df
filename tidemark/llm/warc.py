"""WARC records in ZIP packages: writing, and reading by range.

An archive is a ZIP file with two stored (not deflated) members: ``records.warc.gz``, in which each record is a gzip
member of its own, and ``index.cdxj``, a line for each record with its offset and length in the first member. The
reader finds the end-of-central-directory record (and the ZIP64 one where offsets or sizes need it), reads the
central directory, locates the two members, reads the index and then each record by its byte range. Nothing is
extracted.

Archives are written by tasks into the cluster's shared folder, under names of their own, and only those that the
job's committed manifest names are read: a task that is run twice leaves an unread file, never a repeated record.

Records with equal payloads: the one with the largest page_id is a response, the others are revisits of it.

Defined results: a null html is the empty payload; empty payloads are equal payloads like any others; a null page_id
sorts below all others; repeated rows (the same page_id twice with one html) are all responses where that page_id is
the largest; a very long payload is one record, held by the task that writes or reads it; an empty table gives an empty
result; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, partitions, shared_dir

RECORDS, INDEX = "records.warc.gz", "index.cdxj"
#: Uncompressed bytes of an archive's records, about, and those of a record besides its payload and URL.
ARCHIVE_BYTES, RECORD_BYTES = 32 << 20, 512
#: Records that one reading task takes from an archive at a time.
RANGE_RECORDS = 2000

# Signatures and limits of the ZIP format.
LOCAL_HEADER, CENTRAL_HEADER, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
EXTRA64 = 0x0001


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing -------------------------------------------------------------------------------------------------------


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit that names the page it refers to.

    ``WARC-Page-URL`` is the URL as a JSON text, null and line breaks included; the target URI has neither.
    """
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Page-URL", json.dumps(url)),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Page-ID", str(refers_to)),
        ]
    body = b"" if revisit else payload
    fields.append(("Content-Length", str(len(body))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


class ZipWriter:
    """Stored members appended to a stream; sizes that 32 bits can't hold use ZIP64 fields."""

    def __init__(self, stream: pa.NativeFile, force64: bool = False) -> None:
        self.stream, self.at, self.force64 = stream, 0, force64
        self.members: list[tuple[bytes, int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        raw, size, crc, start = name.encode(), sum(map(len, parts)), 0, self.at
        for p in parts:
            crc = zlib.crc32(p, crc)
        big = self.force64 or size >= MAX32
        extra = struct.pack("<HHQQ", EXTRA64, 16, size, size) if big else b""
        short = MAX32 if big else size
        version = 45 if big else 20
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL_HEADER, version, 0, 0, 0, 0x21, crc, short, short, len(raw), len(extra)))
        self._put(raw + extra)
        for p in parts:
            self._put(p)
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.members:
            wide = [v for v in (size, size, offset) if self.force64 or v >= MAX32]
            extra = struct.pack(f"<HH{len(wide)}Q", EXTRA64, 8 * len(wide), *wide) if wide else b""
            size32 = MAX32 if self.force64 or size >= MAX32 else size
            offset32 = MAX32 if self.force64 or offset >= MAX32 else offset
            head = (CENTRAL_HEADER, 45, 45 if wide else 20, 0, 0, 0, 0x21, crc, size32, size32, len(raw), len(extra))
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", *head, 0, 0, 0, 0, offset32) + raw + extra)
        n, size, end64 = len(self.members), self.at - start, self.at
        if self.force64 or n >= MAX16 or size >= MAX32 or start >= MAX32:
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            n, size, start = MAX16, MAX32, MAX32
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))


def write_archive(
    folder: str, pages: list[tuple[int | None, str | None, bytes, int | None]], date: str, step: int = RANGE_RECORDS
) -> tuple[str, list[tuple[int, int]]]:
    """Write (page_id, url, payload, refers_to) rows as one archive.

    Returns its name, and offset and length of each ``step`` lines of its index.
    """
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    records, lines, at = [], [], 0
    for page_id, url, payload, refers_to in pages:
        packed = gzip.compress(warc_record(page_id, url, payload, payload_digest(payload), refers_to, date), 6, mtime=0)
        lines.append(json.dumps({"url": url, "offset": at, "length": len(packed)}).encode() + b"\n")
        records.append(packed)
        at += len(packed)
    name = f"{path}/{uuid.uuid4().hex}.zip"
    with fs.open_output_stream(name) as stream:
        archive = ZipWriter(stream)
        archive.add(RECORDS, records)
        archive.add(INDEX, lines)
        archive.close()
    ranges, start = [], 0
    for lo in range(0, len(lines), step):
        size = sum(map(len, lines[lo : lo + step]))
        ranges.append((start, size))
        start += size
    return name.rpartition("/")[2], ranges


# --- reading -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    size: int
    header: int


def _at(file: pa.NativeFile, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def directory(file: pa.NativeFile) -> list[Member]:
    """Members of a ZIP file, from its central directory."""
    total = file.size()
    tail_start = max(0, total - (MAX16 + 22))
    tail = _at(file, tail_start, total - tail_start)
    end = len(tail)
    while True:  # the comment may hold the signature: the record must reach the end of the file
        end = tail.rfind(struct.pack("<I", END), 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
    _, _, _, _, n, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, end)
    place = tail_start + end
    if (n == MAX16 or size == MAX32 or start == MAX32) and place >= 20:
        mark, _, end64, _ = struct.unpack("<IIQI", _at(file, place - 20, 20))
        if mark == LOCATOR64:
            fields = struct.unpack("<IQHHIIQQQQ", _at(file, end64, 56))
            if fields[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            n, size, start = fields[7], fields[8], fields[9]
    raw, at, members = _at(file, start, size), 0, []
    for _ in range(n):
        f = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if f[0] != CENTRAL_HEADER:
            raise ValueError("broken central directory")
        method, crc, packed, plain, n_name, n_extra, n_comment, header = f[4], f[7], f[8], f[9], f[10], f[11], f[12], f[16]
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra, e = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, e)
            if kind == EXTRA64:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                plain = next(wide) if plain == MAX32 else plain
                packed = next(wide) if packed == MAX32 else packed
                header = next(wide) if header == MAX32 else header
            e += 4 + length
        members.append(Member(name, method, crc, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_start(file: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin; its local header has name and extra lengths of its own."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    head = struct.unpack("<IHHHHHIIIHH", _at(file, member.header, 30))
    if head[0] != LOCAL_HEADER:
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + head[9] + head[10]


def read_index(file: pa.NativeFile, offset: int = 0, size: int | None = None) -> tuple[int, list[dict]]:
    """Start of the records member, and the index lines in a range of bytes, all by default."""
    members = {m.name: m for m in directory(file)}
    lines = _at(file, stored_start(file, members[INDEX]) + offset, members[INDEX].size - offset if size is None else size)
    return stored_start(file, members[RECORDS]), [json.loads(x) for x in lines.splitlines()]


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    raw = gzip.decompress(packed)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


# --- as Spark jobs -------------------------------------------------------------------------------------------------


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with ``refers_to``: the largest page_id with the same payload, null for that page itself.

    Digests are counted first with partial sums, so pages of a common payload don't meet in one task; the join back
    is one that Spark splits where a digest is frequent.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    tagged = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    groups = (
        tagged.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("d"), "last")
    )
    met = tagged.join(groups, F.col("digest") == F.col("d"), "left")
    return met.select("page_id", "url", "payload", "last")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write the pages into ZIP archives below ``folder``; the manifest (archive, index_at, index_bytes), a range of an
    archive's index in each row, is itself written to the shared folder."""
    limit, step = ARCHIVE_BYTES, RANGE_RECORDS
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")  # one for the job: a task that runs twice writes the same

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name, ranges = write_archive(folder, held, date, step)
            columns = ([name] * len(ranges), [at for at, _ in ranges], [size for _, size in ranges])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["archive", "index_at", "index_bytes"],
            )

        for batch in batches:
            for page_id, url, payload, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((page_id, url, payload, None if page_id == last else last))
                size += len(payload) + len(url or "") + RECORD_BYTES
                if size >= limit:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = with_references(pages, least_bytes)
    return materialize(rows.mapInArrow(write, "archive string, index_at bigint, index_bytes bigint"))


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    A task reads a range of an archive's index; a revisit's payload is null.
    """
    out = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for batch in batches:
            for archive, index_at, index_bytes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{path}/{archive}") as file:
                    start, index = read_index(file, index_at, index_bytes)
                    rows, size = [], 0
                    for line in index:
                        fields, payload = parse_record(_at(file, start + line["offset"], line["length"]))
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and payload_digest(payload) != digest:
                            raise ValueError(f"{archive}: broken payload of page {fields['WARC-Page-ID']}")
                        rows.append(
                            {
                                "page_id": int(fields["WARC-Page-ID"]) if fields["WARC-Page-ID"] else None,
                                "url": json.loads(fields["WARC-Page-URL"]),
                                "record_type": fields["WARC-Type"],
                                "refers_to": int(fields["WARC-Refers-To-Page-ID"]) if revisit else None,
                                "payload_digest": digest,
                                "payload_bytes": int(fields["WARC-Payload-Length"]),
                                "payload": None if revisit else payload,
                            }
                        )
                        size += len(payload)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, out)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, out)

    schema = (
        "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
        "payload_bytes bigint, payload binary"
    )
    return manifest.repartition(partitions(spark)).mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read their records back, without payloads."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    manifest = write_archives(pages.select("page_id", "url", "html"), folder)
    return read_archives(spark, manifest, folder).drop("payload")
