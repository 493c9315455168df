"""Known forms against a plain scan; random tokens are found and words are not."""

import base64
import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest

from tidemark.llm import secrets

SCHEMA = "doc_id long, text string, n_chars long, row string, base string, spans string"


def plain_base(text):
    text, out = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, (pattern, ok) in enumerate(
        ((assign, lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))
    ):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if ok(m)]
    return sorted(out)


def texts():
    rnd = random.Random(11)
    pieces = ["password = ", "Token:", "api_key='", '"secret": "', "AKIA", "abcdef0123456789" * 2, "x" * 5, " ", "é", "\U0001f600", "=", "token: token: ", "ABCDEFGH12345678", "hunter2!", "\n"]
    made = ["".join(rnd.choices(pieces, k=rnd.randint(0, 25))) for _ in range(200)]
    return [None, "", "token=abc", "tOkEn=abcdef", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "0" * 23, "0" * 24, "é" * 30_000 + " secret=abcdef12", *made]


def docs(spark, values):
    return spark.createDataFrame([(i, t, len(t or ""), "a", "b", "c") for i, t in enumerate(values)], SCHEMA)


def test_known_forms_match_plain(spark):
    values = texts()
    for r in secrets.secret_scan(docs(spark, values)).collect():
        base = plain_base(values[r.doc_id])
        listed = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == listed


def test_random_tokens_are_added(spark):
    rnd = random.Random(12)
    keys = [base64.b64encode(rnd.randbytes(30)).decode() for _ in range(40)]
    keys += ["".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(40)]
    words = ["theQuickBrownFoxJumpsOverTheLazyDog", "internationalizationOfStrings2", "xxxxxxxxxxxxxxxxxxxxxxxx1", "getUserAccountSettingsFromServer", "/usr/local/share/documentation/file2"]
    values = [f"see {k} here" for k in keys] + [f"see {w} here" for w in words * 8] + ["antidisestablishmentarianism"]
    got = {r.doc_id: r.spans for r in secrets.secret_scan(docs(spark, values)).collect()}
    found = sum(got[i].startswith("random:4:") for i in range(len(keys)))
    assert found >= 0.9 * len(keys)
    assert sum(bool(got[i]) for i in range(len(keys), len(values))) <= 2


def plain_p(token):
    """Chi-squared of characters and of their kinds, runs and serial correlation, by hand."""
    shown = token.rstrip("=")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", shown):
        alphabet, shown = "0123456789abcdef", shown.lower()
    elif re.fullmatch("[A-Z2-7]+", shown):
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    elif re.fullmatch("[A-Za-z0-9]+", shown):
        alphabet = letters
    else:
        alphabet, shown = letters + "+/", shown.replace("-", "+").replace("_", "/")
    n, k = len(shown), len(alphabet)
    chi = k / n * sum(c * c for c in Counter(shown).values()) - n
    single = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    grouped, kinds = 0, 0
    for kind in ("[a-z]", "[A-Z]", "[0-9]"):
        expected = len(re.findall(kind, alphabet)) / k * n
        if expected:
            grouped += (len(re.findall(kind, shown)) - expected) ** 2 / expected
            kinds += 1
    df = max(1, kinds - 1)
    by_kind = ((grouped / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    x = [alphabet.index(c) + 1 for c in shown]
    high = sum(v > k / 2 for v in x)
    low, runs = n - high, 1 + sum((a > k / 2) != (b > k / 2) for a, b in zip(x, x[1:]))
    mean = 2 * high * low / n + 1
    turns = 99.0 if min(high, low) < 1 else abs(runs - mean) / max(math.sqrt(max(0, (mean - 1) * (mean - 2) / (n - 1))), 0.1)
    own = sum(v * v for v in x) - sum(x) ** 2 / n
    serial = 99.0 if own <= 0 else abs((sum(a * b for a, b in zip(x, x[1:])) - sum(x) ** 2 / n) / own) * math.sqrt(n)
    z = max(0, single, by_kind) ** 2 + turns**2 + serial**2
    return math.erfc(math.sqrt(z / 2)) + math.sqrt(2 * z / math.pi) * math.exp(-z / 2)


def tokens():
    rnd = random.Random(19)
    made = ["".join(rnd.choices(string.ascii_letters + string.digits, k=n)) for n in (20, 24, 32, 40, 64) for _ in range(40)]
    made += [base64.b64encode(rnd.randbytes(rnd.randint(15, 60))).decode() for _ in range(60)]
    made += ["".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=rnd.randint(20, 50))) for _ in range(30)]
    words = "get User Account Settings from server local share file documentation index path value name 2 10 _ - /".split()
    return made + ["".join(rnd.choices(words, k=9)).ljust(20, "e") for _ in range(150)] + ["a" * 30 + "1", "ab" * 15 + "7"]


def test_battery_matches_plain(spark):
    values = tokens()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "id int, t string")
    for r in frame.select("id", secrets.battery(frame["t"]).alias("p")).collect():
        assert r.p == pytest.approx(plain_p(values[r.id]), abs=3e-7)


def test_false_discovery_control_matches_plain(spark):
    values = tokens()
    lengths = [sum(len(t) >= x for x in secrets.LENGTHS[1:]) for t in values]
    depth = [min(secrets.BINS - 1, math.floor(-math.log10(max(plain_p(t), 1e-300)) * secrets.BINS / secrets.DEEPEST)) for t in values]
    edge = lambda d: 10.0 ** (-d * secrets.DEEPEST / secrets.BINS)
    kept, judged = set(), [i for i, t in enumerate(values) if re.search("[A-Za-z]", t) and (re.search("[0-9]", t) or (re.search("[a-z]", t) and re.search("[A-Z]", t)))]
    judged = [i for i in judged if not plain_base(f"see {values[i]} here")]
    for c in set(lengths):
        mine = [i for i in judged if lengths[i] == c]
        passed = [d for d in {depth[i] for i in mine} if edge(d) * len(mine) <= secrets.RATE * sum(depth[i] >= d for i in mine)]
        kept |= {i for i in mine if depth[i] < min(passed, default=secrets.BINS)}
    got = {r.doc_id for r in secrets.secret_scan(docs(spark, [f"see {t} here" for t in values])).collect() if "random" in r.spans}
    assert len(got ^ kept) <= 2  # depths at the edge of a bin: the complementary error function is approximated
    for n, least in ((20, 0.8), (24, 0.75), (32, 0.8), (40, 0.85), (64, 0.9)):  # recall by length
        mine = [i for i, t in enumerate(values[:200]) if len(t) == n]
        assert sum(i in got for i in mine) >= least * len(mine)


def test_many_matches_in_a_text(spark):
    text = " ".join(f"token={'x' * (i % 9)}{i:06}" for i in range(3000))
    found = secrets.secret_scan(docs(spark, [text])).first()
    base = plain_base(text)
    assert found.n_assign == 3000 and found.spans == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)


def test_redaction(spark):
    values = texts()
    frame = docs(spark, values)
    got = {r.doc_id: r for r in secrets.redacted(frame).collect()}
    assert secrets.redacted(frame).columns == frame.columns
    for i, t in enumerate(values):
        at, out = 0, ""
        for a, _, b in plain_base(t):
            if a >= at:
                out += t[at:a] + secrets.REPLACEMENT
            at = max(at, b)
        assert got[i].text == (t if t is None or not plain_base(t) else out + t[at:])
        assert got[i].n_chars == len(got[i].text or "") and got[i].row == "a"


def test_empty_table(spark):
    assert secrets.secret_scan(docs(spark, ["x"]).limit(0)).count() == 0
