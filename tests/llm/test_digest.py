"""Digests against a plain rewrite in document order."""

import hashlib
import math
import random

import pytest

from tidemark.llm import digest

SCHEMA = "doc_id long, text string, at string, cell string"


def plain_digest(data):
    """Length code and quartiles of the 256 buckets, by hand."""
    counts = [0] * 256
    for a, b, c in zip(data, data[1:], data[2:]):
        counts[((a + 256 * b + 65536 * c) * 2654435761 % 2**32) >> 24] += 1
    ranked = sorted(counts)
    return min(255, round(8 * math.log2(1 + len(data)))), [sum(n > ranked[q] for q in (63, 127, 191)) for n in counts]


def plain_hex(data):
    length, codes = plain_digest(data)
    return f"{length:02x}" + "".join(f"{sum(codes[i + k] << 2 * k for k in range(4)):02x}" for i in range(0, 256, 4))


def plain_likeness(a, b):
    (m, x), (n, y) = plain_digest(a), plain_digest(b)
    return 1 - min(416, sum((0, 1, 2, 6)[abs(i - j)] for i, j in zip(x, y)) + min(24, abs(m - n))) / 416


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (doc_id, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = (text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()
        own = text.encode()
        near = (round(plain_likeness(own, edited), 9), round(plain_likeness(own, after.encode()), 9))
        out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), plain_hex(own), plain_hex(edited), *near))
    return out


@pytest.mark.parametrize("n", [1, 2, 200])
def test_edits_match_plain(spark, n):
    rnd = random.Random(n)
    texts = [None, "", "é", "ab", "long " * 60_000] + ["".join(rnd.choices("abcdefgh é\U0001f600", k=rnd.randint(0, 300))) for _ in range(n)]
    rows = [(i * 7 - 3 if i % 40 else None, t, "x", "y") for i, t in enumerate(texts[:n] if n < 3 else texts)]
    rnd.shuffle(rows)
    got = digest.compare_with_next(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    found = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(found, key=key) == sorted(plain(rows), key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_likeness_orders_edits():
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(4000)]
    a, b = " ".join(words[:900]), " ".join(words[2000:2900])
    small, half = a.replace(words[5], "changed"), a[: len(a) // 2] + b[: len(a) // 2]
    prints = [digest.fingerprint(x.encode()) for x in (a, small, half, b)]
    scores = [digest.likeness(prints[0], p) for p in prints]
    assert scores[0] == 1 and scores[0] > scores[1] > scores[2] > scores[3]
    assert digest.difference(prints[0], prints[3]) == digest.difference(prints[3], prints[0])


def test_empty_table(spark):
    assert digest.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0
