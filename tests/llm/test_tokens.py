"""Token files against the tokenizer on whole texts; selective reads, encodings and page indexes of the files."""

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part string, ids string, at string, start string"
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
PIECES = ["the", " ", "  ", "\n", "\r\n", "\t", "'s", "''s", "été", "ß", "3.14", "日本語", "\U0001f600", "\x00", "don't", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "᠎", "​", "﻿", "<|endoftext|>", "#$%"]


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=30))
def test_units_are_cut_where_the_tokenizer_cuts(pieces):
    text = "".join(pieces)
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    encoder = tokens.UnitEncoder(PLAIN, most=40)
    assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == plain(text)


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    rows = [(None, "null id"), (None, None), (3, None), (3, ""), (7, "same"), (7, "same"), (5, "long text " * 30_000)]
    rows += [(rnd.randrange(10_000), "".join(rnd.choices(PIECES, k=rnd.randint(0, 60)))) for _ in range(400)]
    return rows, spark.createDataFrame([(*r, "x", None, None, "y") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def dataset(docs, tmp_path_factory):
    return tokens.write_tokens(docs[1], PATH, f"file://{tmp_path_factory.mktemp('tokens')}/d", page_bytes=2048, page_rows=20, parts=6)


def wanted(rows):
    return [(i, np.array([*plain(t), 0], "<u4")) for i, t in rows]


def test_read_back(spark, docs, dataset):
    found = sorted(tokens.read_tokens(spark, dataset).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in found] == sorted(r.doc_id is not None for r in found)
    ids = [r.doc_id for r in found if r.doc_id is not None]
    assert ids == sorted(ids)
    total = 0
    for r in found:
        assert r.start == total and r.n_tokens == len(r.ids)
        total += r.n_tokens
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in found), key=key) == sorted(((i, x.tolist()) for i, x in wanted(docs[0])), key=key)


def test_digests(docs):
    rows, frame = docs
    got = tokens.token_file_digests(frame, PATH).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    made = sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in wanted(rows)), key=key)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == made
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_windows(spark, docs, dataset):
    rows = sorted(tokens.read_tokens(spark, dataset).collect(), key=lambda r: r.start)
    stream = [x for r in rows for x in r.ids]
    for begin, end in ((0, 1), (5, 900), (1000, 1003), (len(stream) - 4, len(stream) + 9), (len(stream), len(stream) + 1)):
        found = sorted(tokens.read_window(spark, dataset, begin, end).collect(), key=lambda r: r.start)
        assert [x for r in found for x in r.ids] == stream[begin:end]


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_selective_reads(spark, dataset):
    metadata = plan_of(tokens.read_tokens(spark, dataset).select("doc_id", "start", "n_tokens"))
    assert "ids:array" not in metadata.split("== Physical Plan ==")[1]
    some = tokens.read_tokens(spark, dataset, 100, 300)
    assert "GreaterThanOrEqual(doc_id,100)" in plan_of(some)
    every = tokens.read_tokens(spark, dataset).filter("doc_id between 100 and 300")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect()))


@pytest.mark.parametrize("encoding, name", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_files(spark, docs, tmp_path, encoding, name):
    path = f"{tmp_path}/d"
    tokens.write_tokens(docs[1], PATH, f"file://{path}", encoding=encoding, group_bytes=1 << 12, page_bytes=512, page_rows=20, parts=3)
    files = sorted(Path(path, "tokens").glob("*.parquet"))
    assert len(files) == 3
    groups, last = 0, None
    for f in files:
        meta = pq.read_metadata(f)
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert name in columns["ids.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
        here = [x for x in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist() if x is not None]
        assert here == sorted(here) and (last is None or not here or here[0] >= last)
        last = here[-1] if here else last
    assert groups > 3
    assert tokens.read_tokens(spark, f"file://{path}").count() == len(docs[0])


def test_empty(spark, docs):
    assert tokens.token_file_digests(docs[1].limit(0), PATH).count() == 0
