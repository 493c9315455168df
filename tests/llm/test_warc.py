"""ZIP directories against the standard library, and round trips of pages."""

import base64
import hashlib
import io
import random
import zipfile

import pyarrow as pa
import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


@pytest.mark.parametrize("force64", [False, True])
def test_directory_of_own_and_library_archives(tmp_path, force64):
    own = tmp_path / "own.zip"
    with pa.OSFile(str(own), "wb") as stream:
        archive = warc.ZipWriter(stream, force64)
        archive.add("a.bin", [b"one", b"two"])
        archive.add("é.txt", [])
        archive.close()
    with zipfile.ZipFile(own) as z:
        assert z.read("a.bin") == b"onetwo" and z.testzip() is None
    library = tmp_path / "library.zip"
    with zipfile.ZipFile(library, "w") as z:
        with z.open("x", "w", force_zip64=force64) as f:
            f.write(b"payload")
        z.writestr("y", b"second")
        z.comment = b"a comment with PK\x05\x06 inside"
    for path, wanted in ((own, {"a.bin": b"onetwo"}), (library, {"x": b"payload", "y": b"second"})):
        with pa.OSFile(str(path)) as file:
            found = {m.name: warc._at(file, warc.stored_start(file, m), m.size) for m in warc.directory(file)}
        assert {k: found[k] for k in wanted} == wanted


def test_deflated_members_are_refused():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"aaaa" * 100)
    file = pa.BufferReader(raw.getvalue())
    with pytest.raises(ValueError):
        warc.stored_start(file, warc.directory(file)[0])


def test_round_trip(spark, monkeypatch):
    rnd = random.Random(6)
    bodies = [None, "", "x", "é\r\n\r\nWARC/1.1", "y" * 200_000] + [str(i) for i in range(30)]
    rows = [(i if i else None, rnd.choice(["http://a/", None, "u\nv"]), rnd.choice(bodies), "clash") for i in range(300)]
    rows.append(rows[-1])
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    last = {}
    for page_id, _, html, _ in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page_id is None else page_id)
    assert len(got) == len(rows)
    by_page = {i: (h or "").encode() for i, _, h, _ in rows}
    assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(i), str(u)) for i, u, *_ in rows)
    for r in got:
        payload = by_page[r.page_id]
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if r.record_type == "response":
            assert r.refers_to is None and r.page_id == last[payload.decode()]
        else:
            assert r.refers_to == last[payload.decode()]
    assert len({r.page_id for r in got if r.record_type == "response"}) == len(last)


def test_payloads_come_back(spark):
    docs = spark.createDataFrame([(1, "u", "<p>é</p>", ""), (2, "v", "<p>é</p>", "")], SCHEMA)
    folder = warc.shared_dir(spark)
    manifest = warc.write_archives(docs, folder)
    got = {r.page_id: r.payload for r in warc.read_archives(spark, manifest, folder).collect()}
    assert "WARC-Date: 2" in warc.warc_record(1, None, b"", "D", None, "2024-01-01T00:00:00Z").decode()
    assert got[1] is None and bytes(got[2]).decode() == "<p>é</p>"


def test_archives_of_small_records_are_cut_and_read_by_ranges(spark, monkeypatch):
    rows = [(i, f"u{i}", None if i % 2 else "", "") for i in range(3000)]
    folder = warc.shared_dir(spark)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 19)
    monkeypatch.setattr(warc, "RANGE_RECORDS", 300)
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder)
    found = manifest.groupBy("archive").count().collect()
    assert len(found) > 2 and manifest.count() > len(found)
    got = warc.read_archives(spark, manifest, folder).collect()
    assert sorted((r.page_id, r.url) for r in got) == [(i, f"u{i}") for i in range(3000)]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
