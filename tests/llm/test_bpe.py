"""Encoding against the tokenizer library on whole texts, and exact round trips."""

import hashlib
import random

import public_tokenizers
import tiktoken

from tidemark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string"


def texts():
    rnd = random.Random(5)
    pieces = ["the", " ", "  ", "\n", "\t\n", "'s", "''s", "'", "été", "ß", "１２", "3.14", "日本語", "\U0001f600", "\x00", "don't", "���", "#$%", "a" * 300]
    made = ["".join(rnd.choices(pieces, k=rnd.randint(0, 80))) for _ in range(150)]
    return [None, "", " ", "\n\n", "x " * 20_000, *made, *made[:5]]


def test_ids_and_round_trip(spark):
    rows = [(i if i % 50 else None, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    wanted = sorted((i is None, i or 0, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    for chunk_chars in (200, bpe.CHUNK_CHARS):
        got = bpe.decode(bpe.encode(docs, PATH, PATTERN, chunk_chars), PATH).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.ids, bytes(r.decoded)) for r in got) == wanted


def test_digests(spark):
    docs = spark.createDataFrame([(1, "the été 42", ""), (2, None, "")], SCHEMA)
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in bpe.token_digests(docs, PATH, PATTERN).collect()}
    for i, t in ((1, "the été 42"), (2, "")):
        ids = encoding.encode_ordinary(t)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i] == (len(ids), digest, hashlib.sha256(t.encode()).hexdigest())


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, PATTERN).count() == 0
