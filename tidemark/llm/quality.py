"""Quality rules: distribution divergence from language references.

Every document gets two histograms: character classes, and the most common words of its language. They are
compared by Jensen-Shannon distance (square root of the divergence, base 2) with the mean histograms of all
documents of that language. Documents below a minimum length are not judged by a histogram they are too short
to fill.

Defined results: null or empty text has no words, so ``base_failed``; a document of a null or unknown language is held
against the nearest of the known languages' references, or, where there is none, against the mean of its like; repeated
rows are judged alike; a very long text is judged whole, as one row; an empty table gives an empty result; other columns are neither read nor returned, whatever their
names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, code_points, release, texts_of
from tidemark.llm.ordered import slices

# The most common words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on are as with be at by from or an this not have".split(),
    "fr": "le la de les et un une des en que qui dans pour du au par sur pas est avec ce il plus ne".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "es": "de la que el en y a los se del las un por con una su para es al lo como más pero sus le".split(),
}
# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "newline", "punctuation", "symbol", "other")

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: A histogram is compared from this many characters or words on.
MIN_CHARS = 100
MIN_WORDS_FOR_WORDS = 50
#: Largest distances kept: a limit, and what the sampling noise of a short text may add (over the root of its length).
MAX_CLASS_DISTANCE, CLASS_NOISE = 0.2, 1.5
MAX_WORD_DISTANCE, WORD_NOISE = 0.21, 1.0

#: End of the last plane of letters.
LAST_CODE = 0x40000
#: Shares are added up as whole parts of this: sums, and with them verdicts, do not depend on the order of adding.
SHARE_PARTS = 1 << 20

_WORDS = re.compile(WORD_PATTERN)

VERDICT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,kept:boolean,class_distance:double,word_distance:double>"
)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Character class of each code point below ``LAST_CODE``, beyond which there are no letters."""
    kinds = np.full(LAST_CODE + 1, CLASSES.index("other"), np.uint8)
    by_category = {"Ll": 0, "Lo": 0, "Lm": 0, "Mn": 0, "Mc": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3}
    for c in range(LAST_CODE):
        category = unicodedata.category(chr(c))
        kinds[c] = by_category.get(category, 5 if category[0] == "P" else 6 if category[0] == "S" else 7)
    for c in range(0x09, 0x0E):
        kinds[c] = 3
    kinds[0x0A] = 4
    for c in SYMBOLS:
        kinds[ord(c)] = 6
    return kinds


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    marks = np.zeros(128, np.int64)
    marks[[ord(c) for c in SYMBOLS]] = 1
    return marks


def _language(lang: str | None) -> str:
    return lang if lang in COMMON_WORDS else ""


def _word_list(lang: str) -> list[str]:
    if lang:
        return COMMON_WORDS[lang]
    return sorted({w for words in COMMON_WORDS.values() for w in words})


def _histograms(codes: np.ndarray, words: list[str], lang: str) -> tuple[np.ndarray, np.ndarray]:
    classes = np.bincount(_class_table()[np.minimum(codes, LAST_CODE)], minlength=len(CLASSES)).astype(float)
    index = {w: i for i, w in enumerate(_word_list(lang))}
    counts = np.zeros(len(index) + 1)
    for w in words:
        counts[index.get(w.lower().strip(".,;:!?"), -1)] += 1
    return classes, counts


def _share(counts: np.ndarray) -> np.ndarray:
    total = counts.sum()
    return counts / total if total else counts


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two distributions: 0 for equal ones, 1 for disjoint ones."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0)
        right = np.where(q > 0, q * np.log2(q / m), 0.0)
    return float(np.sqrt(max(0.0, (left.sum() + right.sum()) / 2)))


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the text."""
    if window != 8:
        raise ValueError("windows of eight words are compared by doubling")
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) <= window or len(ids) == len(words):
        return 0
    at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    for step in (1, 2, 4):  # equal pairs, then fours, then eights, by exact renumbering
        pairs = at[:-step] * np.int64(len(words) + 1) + at[step:]
        _, at, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.size == pairs.size:
            return 0
    starts = np.flatnonzero(counts[at] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(lines) - len(set(lines))


def _compared(
    codes: np.ndarray, words: list[str], lang: str, reference: tuple[np.ndarray, np.ndarray]
) -> tuple[bool, float | None, float | None]:
    """Is the text too far from a reference, and its two distances; null where it is too short for one."""
    class_distance = word_distance = None
    far = False
    classes, common = _histograms(codes, words, lang)
    if len(codes) >= MIN_CHARS:
        class_distance = js_distance(_share(classes), reference[0])
        far |= class_distance > MAX_CLASS_DISTANCE + CLASS_NOISE / len(codes) ** 0.5
    if len(words) >= MIN_WORDS_FOR_WORDS:
        word_distance = js_distance(_share(common), reference[1])
        far |= word_distance > MAX_WORD_DISTANCE + WORD_NOISE / len(words) ** 0.5
    return far, class_distance, word_distance


def judge(text: str, lang: str | None, references: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    codes, words = code_points(text), _WORDS.findall(text)
    low = codes[codes < 128]
    n_repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * len(words)
    key = _language(lang)
    named = [k for k in references if k]
    keys = [key] if key in named or not named else named  # of an unknown language: the nearest reference counts
    found = [_compared(codes, words, k, references[k]) for k in keys if k in references]
    far, class_distance, word_distance = min(found, key=lambda d: (d[0], d[1] or 0, d[2] or 0), default=(False, None, None))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": int(_symbol_table()[low].sum()),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": not failed and not far,
        "class_distance": class_distance,
        "word_distance": word_distance,
    }


def language_references(documents: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms of all documents of each language that are long enough to fill one.

    A document weighs one whatever its length. What comes to the driver is one row for each language and bin.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sums: dict[tuple[str, str], np.ndarray] = {}
            for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = _WORDS.findall(text)
                if len(words) < MIN_WORDS_FOR_WORDS or len(text) < MIN_CHARS:
                    continue
                key = _language(lang)
                for kind, counts in zip(("class", "word"), _histograms(code_points(text), words, key), strict=True):
                    share = np.rint(_share(counts) * SHARE_PARTS).astype(np.int64)
                    sums[key, kind] = sums[key, kind] + share if (key, kind) in sums else share
            rows = [(k, kind, i, int(v)) for (k, kind), total in sums.items() for i, v in enumerate(total)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            types = (pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "kind", "bin", "share"]
            )

    found = (
        documents.select("text", "lang")
        .mapInArrow(partial, "lang string, kind string, bin int, share bigint")
        .groupBy("lang", "kind", "bin")
        .agg(F.sum("share").alias("share"))
        .collect()
    )
    totals: dict[tuple[str, str], np.ndarray] = {}
    for r in found:
        size = len(CLASSES) if r.kind == "class" else len(_word_list(r.lang)) + 1
        totals.setdefault((r.lang, r.kind), np.zeros(size))[r.bin] = r.share
    return {k: (_share(totals[k, "class"]), _share(totals[k, "word"])) for k, kind in totals if kind == "class"}


def verdict(text: Column, lang: Column, references: dict[str, tuple[np.ndarray, np.ndarray]]) -> Column:
    """Struct column with the counts, the distances and whether the document is kept."""

    @F.arrow_udf(VERDICT)
    def rules(texts: pa.Array, langs: pa.Array) -> pa.Array:
        pairs = zip(texts, langs.to_pylist(), strict=True)
        found = [judge(t.as_py() or "", x, references) for t, x in pairs]
        kinds = [(f, pa.int64()) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        kinds += [("base_failed", pa.bool_()), ("kept", pa.bool_())]
        kinds += [("class_distance", pa.float64()), ("word_distance", pa.float64())]
        release()
        return pa.StructArray.from_arrays([pa.array([r[f] for r in found], t) for f, t in kinds], [f for f, _ in kinds])

    return rules(text, lang)


def quality_rules(documents: DataFrame, references: dict | None = None) -> DataFrame:
    """One row for each document: doc_id, the counts, the two distances, base_failed and kept."""
    references = language_references(documents) if references is None else references
    judged = documents.select("doc_id", verdict(F.col("text"), F.col("lang"), references).alias("rules"))
    return judged.select("doc_id", "rules.*")


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    references = language_references(documents)
    judged = documents.select(F.struct("*").alias("row"), verdict(F.col("text"), F.col("lang"), references).alias("rules"))
    return judged.filter("rules.kept").select("row.*")
