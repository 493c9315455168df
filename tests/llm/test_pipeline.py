"""The pipeline on the smallest tables: what each stage must keep, and its tokens against the library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tidemark.llm import bpe, secrets
from tidemark.llm.common import materialize

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(materialize(stage(spark, made[-1], SF)))
    return [m.collect() for m in made], [m.columns for m in made]


def test_columns_and_rows(stages):
    rows, columns = stages
    assert all(c == columns[0] for c in columns[1:-1])
    ids = [[r.doc_id for r in x] for x in rows]
    assert set(ids[1]) <= set(ids[0]) and set(ids[2]) <= set(ids[1])
    assert sorted(ids[2]) == sorted(ids[3]) == sorted(ids[4]) == sorted(ids[5])


def test_copies_go_and_first_stays(stages):
    before, after = ({r.doc_id: r.text for r in x} for x in stages[0][1:3])
    first = {}
    for i, t in sorted(before.items()):
        first.setdefault(t, i)
    assert all(first[t] == i for i, t in after.items())
    assert len({t for t in after.values()}) == len(after) > 0


def test_no_secret_is_left(stages):
    before, after = ({r.doc_id: r for r in x} for x in stages[0][2:4])
    changed = [i for i in after if after[i].text != before[i].text]
    assert changed and all(secrets.REPLACEMENT in after[i].text for i in changed)
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_tokens(stages):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages[0][4]}
    for r in stages[0][5]:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert np.sum([r.n_tokens for r in stages[0][5]]) > 0


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[0][5]))
