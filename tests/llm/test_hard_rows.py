"""Every operator and every stage over nulls, long texts, repeats, no rows, and columns with clashing names."""

import pytest

import corpus_pipeline
from tidemark.llm import bpe, digest, mixing, pages, quality, secrets, sharding, simhash, substrings, warc

CLASH = ("row", "rules", "spans", "base", "tokens", "print", "slot", "block", "clean", "cell", "halo", "at", "bucket", "__text", "node", "kind", "hash")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i % 997} of the" for i in range(60_000))
    secret = "password = hunter2hunter2 and " + "the river of stones and the green hill was walked by all of them in a day " * 4
    rows = [(1, long, "en", "a"), (2, secret, "en", "a"), (2, secret, "en", "a"), (3, None, None, None), (None, "the of and to", "en", None), (None, None, None, None), (4, "", "xx", ""), (5, "\n\n \t", "de", "a"), (6, secret.upper(), "en", "b")]
    extra = tuple(None if i % 2 else "x" for i in range(len(CLASH)))
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), *extra) for d, t, lang, s in rows], SCHEMA)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage):
    for frame in (docs, docs.limit(0), docs.filter("text is null")):
        found = stage(spark, frame, "")
        rows = found.collect()
        assert len(rows) <= frame.count()
        if stage is not corpus_pipeline.encode:
            assert found.columns == frame.columns
    if stage in (corpus_pipeline.secret_scan, corpus_pipeline.mix_sources, corpus_pipeline.encode):
        assert len(stage(spark, docs, "").collect()) == docs.count()


@pytest.mark.parametrize(
    "operator",
    [quality.quality_rules, mixing.mix_plan, substrings.substring_digests, sharding.shard_query, secrets.secret_scan, digest.compare_with_next, simhash.simhash_components],
    ids=lambda f: f.__name__,
)
def test_operators(docs, operator):
    for frame in (docs, docs.limit(0), docs.filter("text is null")):
        assert operator(frame).count() == frame.count()


def test_pages(spark):
    schema = "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in (*CLASH, "lines", "kinds", "host", "path", "payload", "digest", "last"))
    extra = (None,) * (len(CLASH) + 7)
    rows = [(None, None, None), (1, "http://[bad", "<p>" * 5000 + "x"), (1, "http://[bad", "<p>" * 5000 + "x"), (2, "", ""), (3, "http://h/a", "<article>" + "long text " * 100_000)]
    frame = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    for f in (frame, frame.limit(0)):
        assert pages.main_texts(f).count() == f.count()
        assert warc.round_trip(f).count() == f.count()


def test_vocabulary_is_whole():
    import public_tokenizers

    table_ = bpe.token_table(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert len(table_) == 50_256 and {bytes([b]) for b in range(256)} <= set(table_)
