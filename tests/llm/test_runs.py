"""Runs against a walk over all periods, collapsing, planted periods and hard rows."""

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import runs

SCHEMA = "doc_id long, text string, runs string, longest string, words string"


def plain_runs(words, least):
    """Every maximal stretch of every period, kept if no smaller period holds over all of it."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            smaller = any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(rnd, n):
    kind = rnd.randrange(5)
    if kind == 0:
        return [rnd.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rnd.randrange(3)] * n
    if kind == 2:  # Fibonacci word: as many runs as a word can have, nearly
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        part = [rnd.randrange(4) for _ in range(rnd.randint(1, 30))]
        text = (part * (n // len(part) + 1))[:n]
        if text:
            text[rnd.randrange(n)] = 9
        return text
    return [rnd.randrange(50) for _ in range(n)]


def test_runs_match_walk():
    rnd = random.Random(3)
    for least in (2, 4, 12):
        for _ in range(250):
            ids = made(rnd, rnd.randint(0, 90))
            assert runs.find_runs(ids, least) == plain_runs(ids, least), (least, ids)


def test_hash_collisions_do_not_matter(monkeypatch):
    """With a hash of a few values nearly all comparisons collide; what is reported still is a run."""
    monkeypatch.setattr(runs, "PRIME", 7)
    monkeypatch.setattr(runs, "BASE", 3)
    rnd = random.Random(4)
    for _ in range(200):
        ids = made(rnd, 80)
        for start, length, period in runs.find_runs(ids, 12):
            part = ids[start : start + length]
            assert part[period:] == part[:-period]
            assert start == 0 or ids[start - 1] != ids[start + period - 1]
            assert start + length == len(ids) or ids[start + length] != ids[start + length - period]


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 12)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in found), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines, kept = "".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(w for i, w in enumerate(words) if i not in gone)
    shape = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shape, sha(lines), sha(kept))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    rows = [(None, "a b " * 20), (None, None), (1, ""), (2, None), (2, None), (3, " \t\n"), (4, "é ü " * 9 + "\x00 日本"), (4, "same " * 12), (5, "same " * 11)]
    for i in range(6, 120):
        rows.append((i, " ".join(f"w{x}" for x in made(rnd, rnd.randint(0, 70)))))
    return rows, spark.createDataFrame([(*r, None, "x", None) for r in rows], SCHEMA).repartition(3)


def test_query_matches_plain(docs):
    rows, frame = docs
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    got = sorted((tuple(r) for r in runs.run_digests(frame).collect()), key=key)
    assert got == sorted((plain_row(*r) for r in rows), key=key)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i)


def test_long_text_and_empty_table(spark, docs):
    long = "x y z " * 100_000
    row = runs.periodic_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert row.n_words == 300_000 and [tuple(r) for r in row.runs] == [(0, 300_000, 3)] and row.collapsed == "x y z"
    assert runs.run_digests(docs[1].limit(0)).count() == 0
