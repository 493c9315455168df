"""Main text of web pages by differencing against the page with the nearest URL.

A page is read into text lines, one for each block, with what its markup says of each: inside an article, or inside
a part that is never main text (menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts,
styles, reader comments). Pages are ordered by host and URL path; each is aligned with the page before it in its host
(the host's first with the one after), and lines that lie on a longest common subsequence of the two are deleted as
template.

Differencing alone deletes what it must keep: two pages with one article share all its lines, and articles of a host
share whole paragraphs; and it keeps what it must delete, since adverts and footers differ from page to page. So lines
that the markup rules out go in any case, and an article that the page marks as such is kept whole. A page is not
differenced against a copy of itself: the nearest page of its host that is none decides, before it or after it, as far
as its cell of the URL order reaches.

Markup is read with an event parser whose character references are decoded once; unclosed and wrongly nested elements
end where HTML says they do for the elements used here, at the latest with the page.

Defined results: null and empty html, and pages without main text, give an empty text; a null or broken URL is a host
of its own with an empty path; pages with equal URLs are ordered by page_id; repeated rows give repeated results; a very
long page is read whole, as one row, and its lines are aligned whole; an empty table gives an empty result; other columns
are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions
from tidemark.llm.ordered import cell_bounds, with_cells

# Elements by their part in a page.
NEVER = frozenset(
    "script style noscript template nav footer aside form button select option textarea input label fieldset iframe"
    " object embed svg canvas math audio video map dialog menu head title".split()
)
ARTICLE = frozenset("article main".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words in a class or id that mark a part which is not main text.
MARKS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside"
    r"|footer|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|signup|login|search|form|share|sharing|social|related|recommend\w*|comments?"
    r"|commentlist|disqus|replies|reply|respond|widget|copyright|legal|pagination|pager|skip|tags)(?:$|[_-])",
    re.IGNORECASE,
)
#: Outside an article only, and on an article itself.
HEADER_MARKS = re.compile(r"^(?:(?:site|page|main|global)[_-])?(?:header|head|top|logo)$", re.IGNORECASE)
ARTICLE_MARKS = re.compile(r"^(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|reply|related|widget)$", re.IGNORECASE)
#: Names of a whole layout, such as has-sidebar.
LAYOUT = re.compile(r"^(?:has|with|without|no|layout|page-with|wp)[_-]", re.IGNORECASE)
SPACE = re.compile(r"\s+")
#: A neighbour that shares more than this part of a page's open text is a copy of the page: what they share may be all.
COPY = 0.85
#: Bytes of html in a cell, about.
CELL_BYTES = 96 << 20
#: A tag that the end of the page cuts off.
CUT_TAG = re.compile(r"<(?:[A-Za-z/!?][^<>]*)?\Z")

KEEP, MAIN, OUT = 0, 1, 2


class _Lines(HTMLParser):
    """Text lines of a page and the kind of each: KEEP, MAIN (in an article) or OUT."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # element, rules out, is an article
        self.out = self.main = 0
        self.parts: list[str] = []
        self.lines: list[str] = []
        self.kinds = bytearray()

    def flush(self) -> None:
        line = SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if line:
            self.lines.append(line)
            self.kinds.append(OUT if self.out else MAIN if self.main else KEEP)

    def _pop(self) -> None:
        _, out, main = self.stack.pop()
        self.out -= out
        self.main -= main

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        given = dict(attrs)
        if tag == "p" or tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            self._end_open(tag)
        named = f"{given.get('class') or ''} {given.get('id') or ''}".split()
        out = (
            tag in NEVER
            or (tag == "header" and not self.main)
            or (given.get("role") or "").lower() in ROLES
            or "hidden" in given
            or (given.get("aria-hidden") or "").lower() == "true"
            or any(self._marked(tag, name) for name in named)
        )
        main = tag in ARTICLE and not self.out
        if tag == "body" and self.stack:  # a head that was not closed
            while self.stack and self.stack[-1][0] != "html":
                self._pop()
        if out and tag in INLINE:
            self.flush()
        self.stack.append((tag, out, main))
        self.out += out
        self.main += main

    def _marked(self, tag: str, name: str) -> bool:
        """Does a class or id mark an element that is not main text?"""
        if tag in ("body", "html", "main") or LAYOUT.match(name):
            return False
        if tag in ARTICLE:
            return bool(ARTICLE_MARKS.match(name))
        return bool(MARKS.search(name) or (not self.main and HEADER_MARKS.match(name)))

    def _end_open(self, tag: str) -> None:
        """A paragraph or item ends the open one of its kind, unless another container lies between."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if name not in INLINE:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE or (self.stack and self.stack[-1][1]):
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in INLINE and name not in INLINE:
                return  # an inline end does not close blocks

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def text_lines(html: str | None) -> tuple[list[str], bytes]:
    """Lines of a page and their kinds."""
    parser = _Lines()
    parser.feed(CUT_TAG.sub("", html or ""))
    parser.close()
    parser.flush()
    return parser.lines, bytes(parser.kinds)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-case host, and path without query, fragment and last slash."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), unquote(parts.path).rstrip("/")
    except ValueError:
        return "", ""


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` lie on a longest common subsequence of ``a`` and ``b``.

    Equal ends are taken off first. The rest is a dynamic program over the bits of one long integer for each line of
    ``b``, traced back from the last lines.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    ends = 0
    while ends < min(len(a), len(b)) - lo and a[-1 - ends] == b[-1 - ends]:
        ends += 1
    common = [True] * lo + [False] * (len(a) - lo - ends) + [True] * ends
    inner, other = a[lo : len(a) - ends], b[lo : len(b) - ends]
    known = set(inner)
    other = [x for x in other if x in known]
    if not inner or not other:
        return common
    places: dict[str, int] = {}
    for i, line in enumerate(inner):
        places[line] = places.get(line, 0) | 1 << i
    full = (1 << len(inner)) - 1
    rows = [full]  # bit i is 0 where the subsequence of the first i + 1 lines grows at i
    for line in other:
        row = rows[-1]
        hit = row & places[line]
        rows.append(((row + hit) | (row - hit)) & full)
    i, j = len(inner) - 1, len(other)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1
        elif not rows[j - 1] >> i & 1:
            j -= 1
        else:
            common[lo + i] = True
            i -= 1
            j -= 1
    return common


def open_text(lines: list[str], kinds: bytes, shared: list[bool]) -> tuple[int, int]:
    """Characters of a page that no mark rules out, and those of them in shared lines."""
    sizes = [(len(x), t) for x, t, k in zip(lines, shared, kinds, strict=True) if k != OUT]
    return sum(n for n, _ in sizes), sum(n for n, t in sizes if t)


def template(page: dict, neighbours: list[dict]) -> list[bool] | None:
    """Lines that a page shares with the first of its neighbours that is not a copy of it; None if all are."""
    for neighbour in neighbours:
        shared = common_lines(page["lines"], neighbour["lines"])
        whole, same = open_text(page["lines"], page["kinds"], shared)
        if same <= COPY * whole and whole:
            return shared
    return None


def main_text(lines: list[str], kinds: bytes, shared: list[bool] | None) -> str:
    """Lines that stay, in order, joined by a space."""
    inside = MAIN in kinds
    kept = []
    for line, kind, gone in zip(lines, kinds, shared or [False] * len(lines), strict=True):
        if kind == MAIN or (kind == KEEP and not inside and not gone):
            kept.append(line)
    return " ".join(kept)


def main_texts(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text and n_chars."""
    spark = pages.sparkSession
    parts = partitions(spark)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [host_and_path(u) for u in batch.column(1).to_pylist()]
            at = [-(1 << 63) if p is None else p for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()), pa.array(at, pa.int64())],
                ["host", "path", "at"],
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, urls = part.column(0).to_pylist(), part.column(1).to_pylist()
                where = [host_and_path(u) for u in urls]
                lines, kinds = zip(*(text_lines(h) for h in part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(urls, pa.string()),
                        pa.array([h for h, _ in where], pa.string()),
                        pa.array([p for _, p in where], pa.string()),
                        pa.array([-(1 << 63) if p is None else p for p in ids], pa.int64()),
                        pa.array(lines, pa.list_(pa.string())),
                        pa.array(kinds, pa.binary()),
                    ],
                    ["page_id", "url", "host", "path", "at", "lines", "kinds"],
                )

    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def result(page: dict, shared: list[bool] | None) -> dict:
        text = main_text(page["lines"], page["kinds"], shared)
        return {"page_id": page["page_id"], "url": page["url"], "text": text, "n_chars": len(text)}

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell come in order, the last page of the cell before first and the first of the next one last."""
        place, before, waiting = None, [], []  # nearest earlier pages, the second other than the first; pages without one
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if place != (row["cell"], row["host"]):
                    made += [result(p, None) for p in waiting]
                    place, before, waiting = (row["cell"], row["host"]), [], []
                found = [(p, template(p, [row])) for p in waiting]
                made += [result(p, shared) for p, shared in found if shared is not None]
                waiting = [p for p, shared in found if shared is None]
                shared = template(row, before)
                if row["halo"] == 0 and shared is None:
                    waiting.append(row)
                elif row["halo"] == 0:
                    made.append(result(row, shared))
                other = before[:1] if before and template(row, before[:1]) is not None else before[1:]
                before = [row, *other]
            yield pa.RecordBatch.from_pylist(made, out)
        yield pa.RecordBatch.from_pylist([result(p, None) for p in waiting], out)

    names = ["host", "path", "at"]
    size = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    cells = max(parts, -(-size // CELL_BYTES))
    highs, lows = cell_bounds(pages.select("page_id", "url").mapInArrow(keys, "host string, path string, at bigint"), cells)
    lines = pages.select("page_id", "url", "html").mapInArrow(
        read,
        "page_id bigint, url string, host string, path string, at bigint, lines array<string>, kinds binary",
    )
    rows = with_cells(lines, names, highs, lows, both=True)
    return (
        rows.repartitionById(cells, F.col("cell"))
        .sortWithinPartitions("cell", *names, "halo")
        .mapInArrow(difference, "page_id bigint, url string, text string, n_chars bigint")
    )
