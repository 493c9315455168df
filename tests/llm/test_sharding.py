"""Shards of equal bytes: whole, gapless, even."""

import random
import zlib
from collections import defaultdict

from tidemark.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, shard string, node string"


def rows(n, hot):
    rnd = random.Random(n)
    out = []
    for i in range(n):
        text = "hot copy " * 5 if i < hot else rnd.choice([None, "", "é" * rnd.randint(0, 50), "w " * rnd.randint(0, 400)])
        out.append((i if i % 77 else None, text, rnd.choice(["en", "fr", None]), rnd.choice(["s0"] * 5 + ["s1", None]), "x", "y"))
    return out


def test_even_whole_and_gapless(spark):
    for n, hot, shards in ((4000, 0, 24), (4000, 1500, 24), (3000, 3000, 5)):
        data = rows(n, hot)
        got = sharding.kd_shards(spark.createDataFrame(data, SCHEMA), shards).collect()
        wanted = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in data)
        assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == wanted
        slots, sizes = defaultdict(list), defaultdict(int)
        for r in got:
            slots[r.shard].append(r.slot)
            sizes[r.shard] += r["size"]
        assert set(slots) == set(range(shards))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        mean = sum(sizes.values()) / shards
        assert max(sizes.values()) < 1.05 * mean + 1000 and min(sizes.values()) > 0.95 * mean - 1000


def test_copies_stay_together(spark):
    data = [(i, f"text {i // 3} " * 20, "en", f"s{i % 4}", "", "") for i in range(9000)]
    data += [(10_000 + i, "one hot copy", "en", f"s{i % 4}", "", "") for i in range(12_000)]
    homes = defaultdict(set)
    for r in sharding.kd_shards(spark.createDataFrame(data, SCHEMA), 8).collect():
        homes[r.doc_id // 3 if r.doc_id < 10_000 else "hot"].add(r.shard)
    hot = homes.pop("hot")
    assert all(len(h) == 1 for h in homes.values()) and len(hot) <= 3


def plain(dims, sizes, points, shards, whole):
    """The exact tree: weighted median along the widest dimension, cut where the left is nearest to its share."""
    if shards == 1 or not points:
        return {0: points}
    spans = [max(dims[p][k] for p in points) - min(dims[p][k] for p in points) for k in range(4)]
    k = max(range(4), key=lambda k: (spans[k] / whole[k], -k))
    half, ranked = -(-shards // 2), sorted(points, key=lambda p: dims[p][k])
    want, below, cut = half / shards * sum(sizes[p] for p in points), 0, 0
    while below + sizes[ranked[cut]] < want:
        below += sizes[ranked[cut]]
        cut += 1
    cut += want - below > below + sizes[ranked[cut]] - want
    left, right = plain(dims, sizes, ranked[:cut], half, whole), plain(dims, sizes, ranked[cut:], shards - half, whole)
    return left | {half + i: p for i, p in right.items()}


def test_tree_matches_plain(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EXACT", 0)
    data = [(i, f"{i} " + t, lang, source, "", "") for i, (_, t, lang, source, *_) in enumerate((r for r in rows(700, 0) if r[1]))]
    total = sum(len(t.encode()) + 8 for _, t, *_ in data)
    for shards in (7,):
        found = sharding.points(spark.createDataFrame(data, SCHEMA), total / shards)
        placed = {r.doc_id: r.node for r in sharding.leaves(found, shards, total / shards).collect()}
        known = {r.doc_id: r for r in found.collect()}
        dims, sizes = {i: r.dims for i, r in known.items()}, {i: r["size"] for i, r in known.items()}
        whole = [max(d[k] for d in dims.values()) - min(d[k] for d in dims.values()) for k in range(4)]
        wanted = plain(dims, sizes, list(dims), shards, whole)
        assert placed == {p: shard for shard, members in wanted.items() for p in members}


def test_few_rows_and_none(spark):
    for n in (0, 1, 5):
        got = sharding.shard_query(spark.createDataFrame(rows(n, 0), SCHEMA)).collect()
        assert len(got) == n and all(0 <= r.shard < 24 and r.law == "bytes" for r in got)
    data = rows(500, 0)
    total = sum(len((t or "").encode()) + 8 for _, t, *_ in data)
    by_bytes = sharding.kd_shards(spark.createDataFrame(data, SCHEMA), None, 20_000)
    assert by_bytes.select("shard").distinct().count() == -(-total // 20_000)
