"""Main text: markup, differencing against the nearest URL, and a plain rewrite of the pairing."""

import random

import pytest

from tidemark.llm import pages

SCHEMA = "page_id long, url string, html string, lines string, cell string"


def text_of(html, neighbour=None):
    lines, kinds = pages.text_lines(html)
    page = {"lines": lines, "kinds": kinds}
    return pages.main_text(lines, kinds, pages.template(page, [{"lines": pages.text_lines(neighbour)[0]}]) if neighbour else None)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><a href="/">Home</a></nav><!-- ad --><div class="ad">Buy {n}</div><div id="cookie-notice">We use cookies</div>
<article><header><h1>Title {n}</h1></header><p><b>One  &amp;
two</b> caf&eacute;&nbsp;{n}<br><p>Thr<i>ee</i> &lt;p&gt; &#x41;</p><aside>Side</aside>
<section id="comments"><article class="comment"><p>First!</p></article></section></article>
<form><label>Mail</label><button>Go</button></form><footer>&copy; {n}</footer></body></html>"""


def test_article_with_everything_around_it():
    assert text_of(PAGE.format(n=7)) == "Title 7 One & two café 7 Three <p> A"
    assert text_of(PAGE.format(n=7), PAGE.format(n=8)) == text_of(PAGE.format(n=7), PAGE.format(n=7)) == text_of(PAGE.format(n=7))


def test_differencing_finds_templates_without_marks():
    page = "<body><div>Top line of all</div><p>Story {n} begins here and goes on.</p><p>It ends {n}.</p><div>Bottom line</div></body>"
    assert text_of(page.format(n=1), page.format(n=2)) == "Story 1 begins here and goes on. It ends 1."
    assert text_of(page.format(n=1), page.format(n=1)) == text_of(page.format(n=1))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt;", "plain <b>"),
        ("<article><p>cut of", "cut of"),
        ("<article><p>cut in a tag</", "cut in a tag"),
        ("<article><p>a<p>b<li>c<li>d", "a b c d"),
        ("<div class='has-sidebar'><main>kept</main><div class='sidebar-left'>gone</div></div>", "kept"),
        ("<article></article><nav>x</nav>", ""),
    ],
)
def test_markup_cases(html, text):
    assert text_of(html) == text


def test_common_lines_match_plain():
    rnd = random.Random(15)
    for _ in range(300):
        a, b = (rnd.choices("abcde", k=rnd.randint(0, 14)) for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        found = pages.common_lines(a, b)
        kept = iter(b)
        assert sum(found) == size[-1][-1]
        assert all(x in kept for x, f in zip(a, found, strict=True) if f)


def test_pairs_follow_url_order(spark):
    rnd = random.Random(16)
    rows = []
    for i in range(400):
        host = rnd.choice(["hot.example"] * 4 + ["a.example", "b.example", None])
        url = host and f"http://{host}/{rnd.choice('xy')}/{rnd.randint(0, 60)}{rnd.choice(['', '/', '?q=1'])}"
        body = "".join(f"<p>{rnd.choice(['shared one', 'shared two', f'own {i} {k} ' * 5])}</p>" for k in range(4))
        rows.append((i if i else None, url, rnd.choice([body] * 20 + [None]), "", ""))
    rows.append(rows[3])
    got = pages.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    order = sorted(rows, key=lambda r: (*pages.host_and_path(r[1]), -1 if r[0] is None else r[0]))
    hosts = {}
    for r in order:
        lines, kinds = pages.text_lines(r[2])
        hosts.setdefault(pages.host_and_path(r[1])[0], []).append((r, {"lines": lines, "kinds": kinds}))
    wanted, differenced = [], 0
    for host in hosts.values():
        for i, (r, page) in enumerate(host):
            # the page before, then the nearest before that which is not its copy, then pages after it
            near = [host[i - 1][1]] if i else []
            near += [q for j in range(i - 2, -1, -1) if pages.template(host[j + 1][1], [q := host[j][1]]) is not None][:1]
            shared = pages.template(page, near)
            if shared is None:
                shared = next((x for _, q in host[i + 1 :] if (x := pages.template(page, [q])) is not None), None)
            differenced += shared is not None and any(shared)
            text = pages.main_text(page["lines"], page["kinds"], shared)
            wanted.append((str(r[0]), str(r[1]), text, len(text)))
    assert differenced > 100
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == sorted(wanted)


def test_copies_of_a_page_lose_their_template(spark, monkeypatch):
    monkeypatch.setattr(pages, "partitions", lambda _: 1)  # one cell
    page = "<div>Top line of all pages of this host</div><p>Story {n} {n} {n}.</p><div>Bottom line</div>"
    same = [(i, f"http://h/{i:03}", page.format(n="one"), "", "") for i in range(6)]
    rows = [*same, (6, "http://h/006", page.format(n="two"), "", ""), (7, "http://h/007", page.format(n="one"), "", "")]
    got = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "Story two two two." if i == 6 else "Story one one one." for i in range(8)}


def test_empty_table(spark):
    assert pages.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0
