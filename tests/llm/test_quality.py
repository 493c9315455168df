"""Quality rules against a plain rewrite, and the verdicts on clean and broken texts."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from tidemark.llm import quality

SCHEMA = "doc_id long, text string, lang string, kept string"


def plain(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        dups,
        len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def test_counts_match_plain(spark):
    rnd = random.Random(1)
    vocabulary = ["a", "the", "é#", "x|y", "\U0001f600", " z", "of"]
    texts = [None, "", " \n\t ", "one", "a b c d e f g h " * 3, "l\nl\n\nl\n m", "ſ K " * 30, "w" * 100_000]
    texts += [rnd.choice([" ", "\n", "\t\x0b"]).join(rnd.choices(vocabulary, k=rnd.randint(0, 60))) for _ in range(80)]
    rows = [(i, t, rnd.choice(["en", "fr", None, "xx"]), "clash") for i, t in enumerate(texts)]
    got = quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r.doc_id: tuple(r[f] for f in fields) for r in got} == {i: plain(t) for i, t, *_ in rows}
    assert not any(r.kept for r in got if r.base_failed)


def plain_class(c):
    if c in " \t\x0b\x0c\r":
        return 3
    if c == "\n":
        return 4
    if c in "#*$%&|<>":
        return 6
    kind = unicodedata.category(c)
    return {"Ll": 0, "Lo": 0, "Lm": 0, "Mn": 0, "Mc": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3}.get(kind, 5 if kind[0] == "P" else 6 if kind[0] == "S" else 7)


def plain_histograms(text, lang):
    names = quality.COMMON_WORDS[lang]
    classes, words = [0] * 8, [0] * (len(names) + 1)
    for c in text:
        classes[plain_class(c)] += 1
    for w in re.findall(r"[^ \t-\r]+", text):
        w = w.lower().strip(".,;:!?")
        words[names.index(w) if w in names else -1] += 1
    share = lambda xs: [x / sum(xs) for x in xs]
    return share(classes), share(words)


def plain_distance(p, q):
    half = sum(a * math.log2(2 * a / (a + b)) for a, b in zip(p, q) if a) + sum(b * math.log2(2 * b / (a + b)) for a, b in zip(p, q) if b)
    return math.sqrt(max(0.0, half / 2))


def test_distances_and_verdicts_match_plain(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(160):
        lang = rnd.choice(["en", "fr"])
        noise = rnd.choice([[], [], ["##", "12345", "QZX"], ["\U0001f600", "\U00020000"]])
        words = quality.COMMON_WORDS[lang] + ["river", "stein", "Piedra,", "walks."] * 8 + noise * rnd.choice([3, 20, 60])
        rows.append((i, " ".join(rnd.choices(words, k=rnd.choice([10, 30, 60, 200]))), lang, ""))
    rows += [(200, " ".join(f"{w} x" for w in "### $$$ %%%".split() * 40), "en", "")]
    means = {}
    for lang in ("en", "fr"):
        made = [plain_histograms(t, x) for _, t, x, _ in rows if x == lang and len(t.split()) >= 50 and len(t) >= 100]
        means[lang] = [[sum(m[k][j] for m in made) / len(made) for j in range(len(made[0][k]))] for k in (0, 1)]
    kept = Counter()
    for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        _, text, lang, _ = next(x for x in rows if x[0] == r.doc_id)
        n, far, mine = len(text.split()), False, plain_histograms(text, lang)
        wanted = [None, None]
        if len(text) >= 100:
            wanted[0] = plain_distance(mine[0], means[lang][0])
            far |= wanted[0] > 0.2 + 1.5 / len(text) ** 0.5
        if n >= 50:
            wanted[1] = plain_distance(mine[1], means[lang][1])
            far |= wanted[1] > 0.21 + 1 / n**0.5
        for got, w in zip((r.class_distance, r.word_distance), wanted, strict=True):
            assert (got is None) == (w is None) and (w is None or got == pytest.approx(w, abs=1e-5))
        assert r.kept == (not plain(text)[5] and not far)
        kept[r.kept, r.base_failed] += 1
    assert kept[True, False] > 50 and kept[False, False] > 3


def test_symbols_go_and_prose_stays(spark):
    rnd = random.Random(2)
    common = quality.COMMON_WORDS["en"]
    prose = [" ".join(rnd.choices(common + ["river", "stone", "walks", "green"] * 9, k=120)) for _ in range(60)]
    junk = [" ".join(f"{w}###" for w in rnd.choices(["river", "stone", "walks", "zz", "qq", "green"], k=120)) for _ in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "") for i, t in enumerate(prose + junk)], SCHEMA)
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == set(range(60))
    assert quality.keep_good(docs).columns == docs.columns


def test_unknown_language_is_held_against_the_nearest(spark):
    rnd = random.Random(3)
    text = lambda lang: " ".join(rnd.choices(quality.COMMON_WORDS[lang] + ["pierre", "stein", "piedra"] * 9, k=150))
    rows = [(i, text(lang), lang, "") for i, lang in enumerate(["en", "fr", "de", "es"] * 15)]
    rows += [(100, text("es"), None, ""), (101, text("de"), "xx", ""), (102, "### " * 150, None, ""), (103, " ".join(f"q{i}###" for i in range(150)), None, "")]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {100, 101} <= kept and not {102, 103} & kept


def test_js_distance_bounds():
    import numpy as np

    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality.js_distance(np.array([0.3, 0.7]), np.array([0.3, 0.7])) == 0


def test_empty_table(spark):
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
