"""Manifests against a plain tree; the law of joining forests; proofs; tampered rows; hard rows."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `group` string, leaf string, part string, tree string, n string, idx string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def plain_levels(digests, arity):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return levels


def plain_rows(rows, arity=8):
    """Rows (doc_id, text, lang, source, n_chars) with everything that the query returns."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf_of(*r))))
        trees.append((ordered, plain_levels([leaf_of(*r) for r in ordered], arity)))
    top = plain_levels([levels[-1][0] for _, levels in trees], arity)
    root, out = top[-1][0], []
    for t, (ordered, levels) in enumerate(trees):
        for i, r in enumerate(ordered):
            leaf = levels[0][i]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
            proof, folded = "", leaf_of(r[0], lower, *r[2:]) if changed else leaf
            for at, tree in ((i, levels), (t, top)):
                for level in tree[:-1]:
                    lo = at // arity * arity
                    run = level[lo : lo + arity]
                    a, b = "".join(run[: at - lo]), "".join(run[at - lo + 1 :])
                    proof += a + b
                    folded = sha(a + folded + b)
                    at //= arity
            out.append((r[0], leaf, levels[-1][0], root, sha(proof), folded, folded == root))
    return out


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, None, "x", None, "y", None, "z") for r in rows], SCHEMA).repartition(parts)


def key(r):
    return tuple((v is not None, v or 0) for v in r)


def documents():
    rnd = random.Random(6)
    sizes = {"en": 700, "de": 64, "fr": 65, "it": 1, "": 8, None: 9, "zé": 2, "日": 3, "\U0001f600": 1}
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            n += 1
            text = rnd.choice([None, "", "Some Text", "lower only", "É Ü 日本", f"T{n} " * rnd.randint(1, 9)])
            rows.append((n * 7, text, lang, rnd.choice([None, "a", "b:1"]), None if text is None else len(text)))
    rows += [(7, "again", "en", "a", 5), (None, "no id", "en", None, 5), (None, "no id", "en", None, 5), (None, None, None, None, None), rows[3], rows[3]]
    rnd.shuffle(rows)
    return rows


def test_query_matches_plain(spark):
    rows = documents()
    got = sorted((tuple(r) for r in merkle.proof_query(frame(spark, rows)).collect()), key=key)
    wanted = sorted(plain_rows(rows), key=key)
    assert got == wanted
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("arity, height", [(2, 1), (3, 2)])
def test_other_arities_and_low_blocks(spark, arity, height):
    """Low blocks, so that most levels are joined to them."""
    rows = documents()
    made = merkle.manifest(merkle.tampered(frame(spark, rows)), arity, 2, height)
    got = sorted((tuple(r) for r in merkle.proofs(made).collect()), key=key)
    assert got == sorted(plain_rows(rows, arity), key=key)


def test_leaves_are_numbered_whatever_the_partitions(spark):
    rows, found = documents(), set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.add(merkle.manifest(merkle.tampered(frame(spark, rows))).root)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1


def test_joining_forests_is_associative():
    rnd = random.Random(1)
    for _ in range(200):
        trees = [rnd.randint(1, 90) for _ in range(rnd.randint(1, 12))]
        leaves = [(t, n, i, hashlib.sha256(f"{t}:{i}".encode()).digest()) for t, n in enumerate(trees) for i in range(n)]
        levels = [plain_levels([d.hex() for t, _, _, d in leaves if t == k], 8)[-1][0] for k in range(len(trees))]
        root = plain_levels(levels, 8)[-1][0]
        cuts = sorted(rnd.sample(range(len(leaves) + 1), min(5, len(leaves))))
        forests = []
        for lo, hi in zip([0, *cuts], [*cuts, len(leaves)], strict=True):
            forest = merkle.Forest(len(trees))
            for t, n, i, d in leaves[lo:hi]:
                forest.add(t, n, 0, i, d)
            assert len(forest.open()) <= 3 * 2 * 7 * 4
            forests.append((forest.open(), list(forest.made)))
        made = [x for _, m in forests for x in m]
        while len(forests) > 1:  # any two, in any order
            a, b = (forests.pop(rnd.randrange(len(forests))) for _ in range(2))
            forest = merkle.Forest(len(trees))
            for x in a[0] + b[0]:
                forest.add(*x)
            made += forest.made
            forests.append((forest.open(), []))
        assert not forests[0][0]
        last = [d for t, _, level, _, d in made if t == merkle.TOP and level == merkle.depth(len(trees))]
        assert [d.hex() for d in last] == [root]
        assert len(made) == len(set(made))


def test_one_row_and_none(spark):
    rows = [(5, "Text", None, None, 4)]
    assert [tuple(r) for r in merkle.proof_query(frame(spark, rows, 1)).collect()] == plain_rows(rows)
    empty = merkle.manifest(merkle.tampered(frame(spark, rows, 1).limit(0)))
    assert empty.root is None and merkle.proofs(empty).count() == 0
