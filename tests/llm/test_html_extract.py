"""Main text of pages: the field against enumeration, held-out pages and layouts, odd pages."""
import html
import itertools
import random
import re

import numpy as np
import pytest

from quern.llm import html_extract as H


def marked_text(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    found = (re.sub(r"<[^>]*>", "", x) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(y for y in (" ".join(html.unescape(x).split()) for x in found) if y)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("page_id < 120").select("page_id", "url", "html").orderBy("page_id").collect()


@pytest.fixture(scope="module")
def field(pages):
    return H.train(H.chains_of([p.html for p in pages[:80]], 6))


def test_chain_sums_and_decoding_are_those_of_enumeration():
    rng = np.random.default_rng(1)
    steps, first = rng.normal(size=(2, 2)), 0.3
    length = np.array([1, 2, 5, 7])
    e = rng.normal(size=(4, 7)) * (np.arange(7)[None] < length[:, None])
    total, chance, expected = H.chain_sums(e, length, steps, first)
    want = np.zeros((2, 2))
    for i, n in enumerate(length):
        score = {y: first * y[0] + sum(e[i, k] * y[k] for k in range(n)) + sum(steps[a][b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=int(n))}
        z = np.logaddexp.reduce(list(score.values()))
        assert np.isclose(z, total[i])
        for k in range(n):
            assert np.isclose(sum(np.exp(s - z) for y, s in score.items() if y[k]), chance[i, k])
        for y, s in score.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += np.exp(s - z)
        got = H.Field({}, steps, first).decode(list(e[i, :n]))
        assert np.isclose(score[tuple(map(int, got))], max(score.values()))
    assert np.allclose(expected, want)
    assert H.Field({}, steps, first).decode([]) == []


def test_pages_outside_the_training_rows(pages, field):
    assert [field.extract(p.html) for p in pages[80:]] == [marked_text(p.html) for p in pages[80:]]


@pytest.mark.parametrize("inside, outside", [
    ('div class="article-content"', ['div class="comments-area"', 'div class="site-footer"', "nav", 'div class="promo-box"']),
    ('div class="blog-entry"', ['div class="main-menu"', 'div class="reader-comments"', 'div id="page-footer"', "aside"]),
    ("div", ['div class="sidebar-left"', "header", "footer", 'div class="cookie"']),
])
def test_layouts_it_has_not_seen(pages, field, inside, outside):
    r, hit, found, want = random.Random(5), 0, 0, 0
    for p in pages[80:]:
        rows = H.labelled(p.html)
        texts, others = [x for _, y, x, _ in rows if y][:10], [x for _, y, x, _ in rows if not y]
        around = lambda: "".join(f"<{k}>" + "".join(f"<p>{html.escape(x)}</p>" for x in r.sample(others, 2)) + f"</{k.split()[0]}>" for k in r.sample(outside, 2))
        page = f"<html><head><title>t</title></head><body>{around()}<{inside}><h1>{html.escape(texts[0])}</h1>" + "".join(f"<p>{html.escape(x)}</p>" for x in texts[1:]) + f"</{inside.split()[0]}>{around()}</body></html>"
        got = set(field.extract(page).split("\n\n"))
        hit, found, want = hit + len(got & set(texts)), found + len(got), want + len(set(texts))
    assert hit / found > 0.85 and hit / want > 0.9


@pytest.mark.parametrize("page, want", [
    ("", []), ("plain & text", ["plain & text"]), ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]), ("<P>x<B>y</B> &amp;lt; &#233;\n z</P>", ["xy &lt; é z"]),
    ("<script>var t='</p>';</script><style>p{}</style>t<title>no</title>", ["t"]), ("<!-- a <p>b</p> --><p>c", ["c"]), ("<p>a <b", ["a"]), ("<p>1 < 2 > 0</p>", ["1 < 2 > 0"]),
    ("<script>never closed <p>x", []), ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("</div></p>x", ["x"]),
    ('<p title="a > b">c</p><p title="lone>d</p>', ["c", "d"]), ("<p> &nbsp; </p><p>a&nbsp;b</p>", ["a b"]), ("<head><title>t</title></head>body", ["body"]),
])
def test_blocks(page, want):
    assert [text for _, text, _, _ in H.blocks(page)] == want


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [t for _, t, _, _ in H.blocks(deep)] == ["x"]
    assert sum(1 for _ in H.blocks("<article>" + "<p>word word</p>" * 200_000)) == 200_000
    assert H.Field({"t:div": 1.0}, np.zeros((2, 2)), 0.0).extract(deep) == "x"


def test_odd_rows_empty_tables_and_unmarked_pages(spark, pages):
    p = pages[0]
    rows = [(p.page_id, p.url, p.html, "clash", 1), (None, None, p.html, None, None), (p.page_id, p.url, p.html, "x", 2), (5, "u", None, None, 0), (6, "u", "", "", 0), (7, None, "<nav>only</nav>", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.extract(df).collect()}
    text = marked_text(p.html)
    assert got[p.page_id, p.url] == got[None, None] == (text, len(text)) and got[5, "u"] == got[6, "u"] == ("", 0) and H.extract(df).count() == 6
    assert H.extract(df.limit(0)).collect() == []
    assert H.extract(df.filter("page_id > 4")).count() == 3


def test_query_reads_every_page(spark, tiny):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    got = H.query(spark, tiny).collect()
    assert len(got) == len(rows) and all(r.text == marked_text(rows[r.page_id]) and r.n_chars == len(r.text) for r in got)
