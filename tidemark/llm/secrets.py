"""Secrets in text: known forms, and a battery of randomness tests on other tokens.

Known forms are assignments to names such as password, access key ids and long hexadecimal runs. Any other run of
key characters is a candidate. Its encoding is inferred from its characters (hexadecimal, base 32, letters and
digits, base 64), and three tests ask whether it could be drawn evenly from that alphabet: chi-squared uniformity
of the characters and their kinds, runs of low and high characters, and serial correlation of neighbours. Their statistics add to
one of chi-squared form with three degrees of freedom, and its p-value states how well randomness explains the token.

Tokens are judged together over the corpus, in classes of length, since short ones cannot fail as clearly as long
ones: the Benjamini-Hochberg procedure finds the tokens that are not random at a false-discovery rate of ``RATE``,
from a histogram of p-values for each class. What it does not discard, and has letters of both kinds or letters and
digits, is reported as a secret of kind ``random``.

Only DataFrame functions are used: matches of a pattern and the pieces between them give positions.

Defined results: null and empty texts have no spans; a candidate that overlaps a known form is not reported again;
repeated rows are scanned alike; a very long text is scanned whole, in one row; an empty table gives an empty result; ``redacted`` returns the input's columns, and
other columns are carried whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

# The known forms. Lengths are those of the whole match, or of group 2.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
# Alphabets of encodings, in the order in which they are tried.
ALPHABETS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alphanumeric", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Lower ends of the classes of length.
LENGTHS = (20, 28, 40, 64, 128)
#: Share of the discarded tokens that may have been random.
RATE = 0.05
#: Bins of a p-value histogram, over minus its decimal logarithm from 0 to ``DEEPEST``.
BINS, DEEPEST = 2000, 40.0
REPLACEMENT = "[REDACTED]"
#: Matches whose places are added up together.
BLOCK = 64

_SPAN = "array<struct<start:int,end:int,text:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """All matches with their places, leftmost and not overlapping; empty where the pattern isn't found.

    Places are running totals of the lengths of matches and of what lies between them: of blocks first, then within each
    block, so that a text with very many matches costs little more than in proportion.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))

    def within(block: Column, begin: Column) -> Column:
        def step(state: Column, pair: Column) -> Column:
            lo = state["at"] + pair["gap"]
            hi = lo + F.length(pair["match"])
            span = F.struct(lo.alias("start"), hi.alias("end"), pair["match"].alias("text"))
            return F.struct(hi.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

        return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast(_SPAN).alias("spans")), step)["spans"]

    def placed(blocks: Column) -> Column:
        widths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["match"])))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        add = lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
        begins = F.aggregate(widths, start, add)["all"]
        return F.flatten(F.zip_with(blocks, begins, within))

    def blocks(all_: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return F.transform(firsts, lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK)))

    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    spans = once(pairs, lambda x: once(blocks(x), placed))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def known_forms(text: Column) -> dict[str, Column]:
    """Spans of each known form in a text that is not null."""
    value = lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2))
    return {
        "assign": F.filter(_matches(text, ASSIGN), lambda s: value(s) >= ASSIGN_LEAST),
        "access": _matches(text, ACCESS),
        "hex": _matches(text, HEX),
    }


def _survival(z: Column) -> Column:
    """Chance that a chi-squared variable with three degrees of freedom exceeds ``z``."""
    x = F.sqrt(z / 2)
    # A rational approximation of the complementary error function.
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    decay = F.exp(-z / 2)
    return F.least(F.lit(1.0), poly * decay + F.sqrt(2 * z / 3.141592653589793) * decay)


def battery(token: Column) -> Column:
    """p-value of a token: how well an even draw from its encoding's alphabet explains it."""
    plain = F.regexp_replace(token, "=+$", "")
    is_hex = plain.rlike(ALPHABETS[0][1])
    alphabet = F.lit(ALPHABETS[-1][2])
    for _, pattern, letters in reversed(ALPHABETS[:-1]):
        alphabet = F.when(plain.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    shown = F.when(is_hex, F.lower(plain)).otherwise(F.translate(plain, "-_", "+/"))
    letters = F.filter(F.split(shown, ""), lambda c: c != "")
    given = F.struct(
        F.transform(letters, lambda c: F.instr(alphabet, c).cast("double")).alias("x"),
        F.length(alphabet).cast("double").alias("k"),
        F.length(shown).cast("double").alias("n"),
        letters.alias("c"),
        shown.alias("s"),
        alphabet.alias("a"),
    )
    # one-element arrays name the intermediate values, so they are computed once
    return F.get(F.transform(F.array(given), _p_value), 0)


def _p_value(g: Column) -> Column:
    x, k, n = g["x"], g["k"], g["n"]
    zero = F.lit(0.0)
    squares = F.aggregate(
        F.array_distinct(g["c"]), zero, lambda a, c: a + F.pow(n - F.length(F.replace(g["s"], c, F.lit(""))), F.lit(2.0))
    )
    chi = k / n * squares - n
    z_single = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    # Cells of single characters are thin in short tokens, so kinds of characters are cells as well. The cube root
    # of a chi-squared variable is nearly normal.
    grouped, kinds = zero, zero
    for kind in ("[a-z]", "[A-Z]", "[0-9]"):
        expected = F.regexp_count(g["a"], F.lit(kind)) / k * n
        got = F.regexp_count(g["s"], F.lit(kind))
        there = expected > 0
        grouped += F.when(there, F.pow(got - expected, F.lit(2.0)) / expected).otherwise(zero)
        kinds += there.cast("double")
    df = F.greatest(F.lit(1.0), kinds - 1)
    z_kinds = (F.pow(grouped / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    z_chi = F.greatest(zero, z_single, z_kinds)
    tail = F.slice(x, F.lit(2), F.size(x) - 1)
    head = F.slice(x, F.lit(1), F.size(x) - 1)
    high = F.aggregate(x, zero, lambda a, v: a + (v > k / 2).cast("double"))
    low = n - high
    runs = 1 + F.aggregate(
        F.zip_with(head, tail, lambda a, b: ((a > k / 2) != (b > k / 2)).cast("double")), zero, lambda a, v: a + v
    )
    mean = 2 * high * low / n + 1
    spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
    z_runs = F.when(F.least(high, low) < 1, F.lit(99.0)).otherwise(F.abs(runs - mean) / F.greatest(spread, F.lit(0.1)))
    total = F.aggregate(x, zero, lambda a, v: a + v)
    own = F.aggregate(x, zero, lambda a, v: a + v * v) - total * total / n
    lagged = F.aggregate(F.zip_with(head, tail, lambda a, b: a * b), zero, lambda a, v: a + v) - total * total / n
    z_serial = F.when(own <= 0, F.lit(99.0)).otherwise(F.abs(lagged / own) * F.sqrt(n))
    return _survival(z_chi * z_chi + z_runs * z_runs + z_serial * z_serial)


def _class(length: Column) -> Column:
    """Class of length of a token."""
    place = F.lit(0)
    for i, least in enumerate(LENGTHS[1:], 1):
        place = F.when(length >= least, i).otherwise(place)
    return place


def _depth(p: Column) -> Column:
    """Bin of a p-value: 0 for one, the last for none."""
    return F.least(F.lit(BINS - 1), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS / DEEPEST)).cast("int")


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    )


def scan(documents: DataFrame) -> DataFrame:
    """``row`` (the input), ``base`` (kind, start, end of known forms, sorted) and ``tokens`` (candidates, judged)."""
    text = F.coalesce("text", F.lit(""))
    forms = known_forms(F.col("__text"))
    found = documents.select(F.struct("*").alias("row"), text.alias("__text")).select(
        "row",
        *[spans.alias(kind) for kind, spans in forms.items()],
        _matches(F.col("__text"), CANDIDATE).alias("candidates"),
    )
    labelled = [_of_kind(F.col(kind), i) for i, kind in enumerate(forms)]
    found = found.select("row", F.array_sort(F.concat(*labelled)).alias("base"), "candidates")
    mixed = lambda t: t.rlike("[A-Za-z]") & (t.rlike("[0-9]") | (t.rlike("[a-z]") & t.rlike("[A-Z]")))
    apart = F.filter(
        "candidates",
        lambda c: mixed(c["text"]) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    judged = F.transform(
        apart,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            _class(F.length(c["text"])).alias("length"),
            _depth(battery(c["text"])).alias("depth"),
        ),
    )
    return found.select("row", "base", F.when(F.size("candidates") > 0, judged).otherwise(F.array()).alias("tokens"))


def discarded_from(scanned: DataFrame, rate: float = RATE) -> list[int]:
    """For each class of length the least depth that is discarded as not random; beyond all bins where none is.

    Benjamini-Hochberg: the greatest p-value whose expected number of tokens is at most ``rate`` of those at or
    below it. A bin counts by its greatest p-value, so the rate is kept.
    """
    bins = (
        scanned.select(F.explode("tokens").alias("t")).groupBy("t.length", "t.depth").agg(F.count(F.lit(1)).alias("n"))
    )
    below = F.sum("n").over(Window.partitionBy("length").orderBy(F.desc("depth")))
    total = F.sum("n").over(Window.partitionBy("length"))
    passed = bins.select("length", "depth", below.alias("below"), total.alias("total")).filter(
        F.pow(F.lit(10.0), -F.col("depth") * DEEPEST / BINS) * F.col("total") <= rate * F.col("below")
    )
    least = {r["length"]: r["least"] for r in passed.groupBy("length").agg(F.min("depth").alias("least")).collect()}
    return [least.get(i, BINS) for i in range(len(LENGTHS))]


def with_spans(scanned: DataFrame, least: list[int]) -> DataFrame:
    """``row`` and ``spans`` (start, kind, end): known forms and random tokens, by start and kind."""
    limit = F.array(*[F.lit(x) for x in least])
    random = F.filter("tokens", lambda t: t["depth"] < F.get(limit, t["length"]))
    added = _of_kind(random, KINDS.index("random"))
    return scanned.select("row", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_scan(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, counts and digest of the known forms, and all spans."""
    scanned = materialize(scan(documents.select("doc_id", "text")).withColumn("row", F.struct("row.doc_id")))
    found = with_spans(scanned, discarded_from(scanned))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "row.doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with every secret replaced; n_chars follows where it is a column."""
    scanned = materialize(scan(documents))
    found = with_spans(scanned, discarded_from(scanned))
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(kept, F.lit(REPLACEMENT))).alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(
            F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        )

    done = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    clean = F.when(F.size("spans") > 0, done).otherwise(text)
    columns = {c: F.col("row")[c] for c in documents.columns}
    columns["text"] = F.col("clean")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(columns["n_chars"])
    return found.withColumn("clean", clean).select(*[v.alias(c) for c, v in columns.items()])
