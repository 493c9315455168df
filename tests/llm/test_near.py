"""Near copies against the similarity of all pairs."""

import random

from tidemark.llm import near

SCHEMA = "doc_id long, text string, print string"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_similar_texts_meet_and_others_do_not(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(60):
        base = rnd.choices(words, k=rnd.randint(60, 600))
        texts.append(" ".join(base))
        for share in (0.0, 0.01, 0.02, 0.1, 0.3):
            copy = [rnd.choice(words) if rnd.random() < share else w for w in base]
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    group = {r.doc_id: r.component_id for r in near.near_components(docs).collect()}
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            alike = len(a & sets[j]) / len(a | sets[j])
            if alike >= 0.85:
                assert group[i] == group[j], (i, j, alike)
            if alike >= 0.65 and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    assert all(label[i] == label[c] for i, c in group.items())  # no chain of less than that
    assert {r.doc_id for r in near.keep_first(docs).collect()} == set(group.values())


def test_large_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near, "GROUP", 8)
    rnd = random.Random(6)
    base = [f"v{rnd.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rnd.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy), "x"))
    assert [r.doc_id for r in near.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_hard_rows(spark):
    rows = [(3, None, "a"), (1, "", "b"), (2, " \n", None), (4, "One two", "c"), (5, "one  TWO", "d"), (None, "one two", "e"), (6, "x " * 50000, "f")]
    kept = near.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "print"]
    assert {r.doc_id for r in kept.collect()} == {None, 1, 4, 6}
    assert near.keep_first(spark.createDataFrame([], SCHEMA)).count() == 0


def grouped(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r.component_id for r in near.near_components(docs).collect()}


def test_pairs_at_the_threshold_link(spark):
    texts = []
    for i in range(60):
        base = [f"b{i}w{k}" for k in range(4 + 440)]  # 400 shared shingles, 50 on each side: exactly 0.8
        texts += [" ".join([*base[:404], *(f"{side}{i}w{k}" for k in range(50))]) for side in "lr"]
    for i in range(60):
        words = [f"s{i}w{k}" for k in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]  # 4 and 5 shingles
    for i in range(60):
        words = [f"t{i}w{k}" for k in range(29)]
        texts += [" ".join(words[:24]), " ".join(words)]  # 20 and 25 shingles
    group = grouped(spark, texts)
    assert [i for i in range(0, len(texts), 2) if group[i] != group[i + 1]] == []


def test_groups_are_chains_of_exact_similarity(spark):
    rnd = random.Random(7)
    texts = []
    for f in range(12):  # a family on one template: every text about 0.6 to 0.9 to others
        base = [f"f{f}w{k}" for k in range(120)]
        for i in range(8):
            own = rnd.randint(0, 30)
            texts.append(" ".join([*base[own:], *(f"o{f}v{i}w{k}" for k in range(own // 2))]))
        chain = [f"c{f}w{k}" for k in range(400)]
        texts += [" ".join(chain[at : at + 124]) for at in range(0, 160, 20)]  # 100 of 140 shingles: 0.71 to the neighbour
        short = [f"z{f}w{k}" for k in range(8)]
        texts += [" ".join(short[:n]) for n in (5, 6, 7, 8)]  # 1 of 2, 2 of 3, 3 of 4 shingles
    texts += [None, " "]
    group = grouped(spark, texts)
    sets = [shingles(t) if t and t.strip() else set() for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if (5 * len(a & sets[j]) >= 4 * len(a | sets[j])) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    assert [group[i] for i in range(len(texts))] == label


def test_rows_of_one_doc_id_go_by_their_texts(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "another text of its own here", "z")]
    assert sorted(r.print for r in near.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()) == ["x", "z"]
