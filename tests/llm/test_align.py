"""Alignment against a plain one of whole texts, token by token."""
import hashlib
from collections import Counter, defaultdict

import pytest

from quern.llm import align


def brute(texts):
    p = align.Pair()
    rows, links_of = [], []
    for t in texts:
        a = p.whole.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = p.b.encode(t) if t else []
        spelt = [b"".join(p.bytes_a[i] for i in a), b"".join(p.bytes_b[i] for i in b)]
        if not t or any(s != b" " + t.encode() for s in spelt):
            rows.append((0, 0, 0, 0, ""))
            links_of.append([])
            continue
        spans = []
        for ids, table in ((a, p.bytes_a), (b, p.bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at = out[-1][1]
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], [0, 0]
        for c in cuts:
            group = []
            for k, side in enumerate(spans):
                first = at[k]
                while at[k] < len(side) and side[at[k]][1] <= c:
                    at[k] += 1
                group.append(",".join(str(i) for _, _, i in side[first : at[k]]))
            groups.append("|".join(group))
        j, links = 0, []
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        rows.append((len(a), len(b), len(groups), len(links), ";".join(groups)))
        links_of.append(links)
    count = Counter(x for links in links_of for x in links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(*r[:4], sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), r[4]) for r, links in zip(rows, links_of)]


def got(df):
    return [tuple(r)[1:] for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").orderBy("doc_id").collect()]


ODD = [
    None, "", " ", "  ", "a", " a", "a  b", "a b c", "a  b", "tab\t x", "\n\n a \n b", "x▁y", "ok ▁", "<|endoftext|> a <s> </s> <0x41> <unk>",
    "it's we'll 's x's ' s", "日本語 テキスト 混ざる text", "\U0001f469‍\U0001f467‍\U0001f466 family é é", "0 12 345 6789 00000000000000000000",
    "a" * 3000, "ab " * 300, "\x00\x01 \x7f", "ЁЖ и мир", "trailing space ", "\u200b \u200b a", "a\u3000b c \u2028 d", "…—“q” €5", "\r\na b\r\n", "a \u0301b",
]


def test_odd_texts(spark):
    texts = ODD * 2 + ["the of and the of " + t for t in ODD if t]
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_a long, groups string").repartition(3)
    assert got(align.align(df)) == brute(texts)
    assert got(align.align(df, batch_bytes=100)) == brute(texts)


def test_documents(spark, tiny, documents, monkeypatch):
    monkeypatch.setattr(align, "PAIRS_SENT", 10)
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    want = [(r.doc_id, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(rows, brute([r.text for r in rows]))]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, align.query(spark, tiny).select(*names).collect())) == want


def test_nulls_repeats_and_empty_tables(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows])))
    assert Counter(map(tuple, align.align(odd).collect())) == want
    assert align.align(empty).collect() == []
    assert got(align.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_every_character_that_needs_no_try_is_written_back():
    p = align.Pair()
    safe = [chr(c) for c in range(0x3000) if align._SAFE.fullmatch(chr(c))]
    assert len(safe) > 500 and all(p.written_back(f"{c}x {c} y{c}") for c in safe)


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_stretches_lose_nothing(text):
    assert " ".join(align.stretches(text)) == text
