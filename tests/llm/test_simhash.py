"""SimHash components against all pairs."""

import random

import numpy as np
import xxhash

from tidemark.llm import simhash

SCHEMA = "doc_id long, text string, component_id string"


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    label = list(range(len(prints)))
    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_components_match_all_pairs(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one", "ÀB c D", "Àb c d", "àb c d"]
    for _ in range(60):
        base = rnd.choices(words, k=rnd.randint(30, 400))
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    prints = [plain_print(t) for t in texts]
    labels = plain_components(prints)
    assert got == {i: (f"{p:016x}", labels[i]) for i, p in enumerate(prints)}
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept == set(labels)


def test_large_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    rnd = random.Random(4)
    center = rnd.getrandbits(64)
    prints = {center}
    while len(prints) < 120:
        prints.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    edges = [(r.a, r.b) for r in simhash.links(frame).collect()]
    index = {(p - (1 << 64) if p >> 63 else p): i for i, p in enumerate(prints)}
    label = list(range(len(prints)))
    for a, b in edges:
        x, y = label[index[a]], label[index[b]]
        label = [min(x, y) if v in (x, y) else v for v in label]
    assert label == plain_components(prints)


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
