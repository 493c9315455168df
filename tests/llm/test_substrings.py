"""Substring removal against a dictionary of all strings of fifty bytes."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import substrings

SCHEMA = "doc_id long, text string, cell string, body string"


def plain(rows):
    rows = [(substrings.NO_DOC if d is None else d, (t or "").encode()) for d, t, *_ in rows]
    first = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(seed):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choices("abcdefg é\n日", k=rnd.randint(20, 130))) for _ in range(12)]
    fillers = ["=" * 70, "ab" * 40, "x", " ", "é" * 30, "".join(rnd.choices("pqrst", k=49)), "".join(rnd.choices("pqrst", k=50))]
    texts = ["".join(rnd.choice(rnd.choice([passages, fillers, ["".join(rnd.choices("uvwxyz", k=40))]])) for _ in range(rnd.randint(0, 9))) for _ in range(120)]
    texts += [None, "", texts[3], texts[3], texts[5][:60], "=" * 3000, "=" * 49]
    rnd.shuffle(texts)
    return [(i // 2 if i % 31 == 0 else i + 1000 if i % 41 else None, t, "x", "y") for i, t in enumerate(texts)]


@pytest.mark.parametrize("cell_bytes", [2000, 1 << 22])
def test_matches_plain(spark, monkeypatch, cell_bytes):
    monkeypatch.setattr(substrings, "CELL_BYTES", cell_bytes)
    monkeypatch.setattr(substrings, "BYTES_PER_RANGE", 1)
    data = rows(cell_bytes)
    got = substrings.substring_digests(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert sorted((substrings.NO_DOC if r[0] is None else r[0], *tuple(r)[1:]) for r in got) == plain(data)


def test_rows_of_one_doc_id_with_different_texts(spark):
    rnd = random.Random(15)
    a, b, c = ("".join(rnd.choices("abcdefghij", k=99)) for _ in range(3))
    data = [(1, a, "", ""), (2, a, "", ""), (2, b, "", ""), (2, b, "", ""), (3, b + c, "", ""), (3, c, "", ""), (4, None, "", "")]
    got = substrings.substring_digests(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == plain(data)
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (2, 0), (2, 99), (3, 0), (3, 99), (4, 0)]


@pytest.mark.parametrize("seed", range(6))
def test_intervals_are_common_prefixes(seed):
    rnd = random.Random(seed)
    text = np.frombuffer(b"".join(bytes(rnd.choices([1, 2, 3][: 1 + seed % 3], k=rnd.randint(60, 150))) + b"\x00" for _ in range(8)), np.uint8)
    order = substrings.suffix_order(text, 8)
    starts = substrings.interval_starts(text, order, 8)
    raw = text.tobytes() + b"\x00" * 8
    heads = [raw[i : i + 8] for i in order.tolist()]
    inner = [q for q in range(1, len(heads)) if 0 not in heads[q - 1] and 0 not in heads[q]]
    assert all(starts[q] == (heads[q] != heads[q - 1]) for q in inner)


def test_every_window_has_one_minimizer():
    rnd = random.Random(14)
    for text in (bytes(rnd.choices(b"ab", k=300)), b"a" * 200, bytes(rnd.choices(range(200), k=500)), b"q" * 50):
        data = np.frombuffer(text, np.uint8)
        low, high = substrings.window_reach(len(data), *substrings.minimizers(data))
        owned = sorted(s for a, b in zip(low.tolist(), high.tolist(), strict=True) for s in range(a, b + 1))
        assert owned == list(range(len(data) - 49))


def test_empty_table(spark):
    assert substrings.substring_digests(spark.createDataFrame([], SCHEMA)).count() == 0
