import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import secret_scan as sc

BASE = (("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, rx, g, least) in enumerate(BASE) for m in rx.finditer(text or "") if len(m[g]) >= least]
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


TEXTS = ["password = 'hunter2secret'", "secret: token = abcdef", "token=abc password:longenough", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 20, "0" * 24, "0" * 23, "é" * 3 + " api_key=\"abc-DEF_1\" " + "deadbeef" * 4, "ghp_" + "a" * 36, "APIKEY:  'x.y=z+/1'", "ſecret=abcdefgh", "", None]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_are_the_plain_scan(text):
    got = sc.Scanner().spans([text or ""])[0]
    assert [f"{sc.RULES[k].kind}:{a}:{b}" for a, k, b in got if sc.RULES[k].base] == brute(text)


def test_whole_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]] for r in sc.scan_secrets(documents).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in documents.collect()}
    assert any(got.values())


def test_queries_hold_for_every_match():
    rng = __import__("random").Random(3)
    padded = ["".join(rng.choices("abc xyz", k=20)) + text for text in filter(None, TEXTS)]
    for _, rule, _, found in sc.Scanner().candidates(padded):
        assert {k for k, t in enumerate(padded) if re.search(rule.pattern, t)} <= set(found)
    assert sc.trigram_query("[0-9a-f]{24,}") == sc.ALL and sc.trigram_query("(ab|cd)*") == sc.ALL
    assert sc.trigram_query("abcd") == ("and", frozenset({("tri", b"abc"), ("tri", b"bcd")}))
    assert sc.trigram_query("(?i)skip") == sc.ALL  # other letters than S, K and I may match these
    assert sc.trigram_query("(?ai:skip)") == ("and", frozenset({("tri", b"ski"), ("tri", b"kip")}))
    assert sc.trigram_query("(?i)é12") == sc.ALL and sc.trigram_query("é1") == ("tri", "é1".encode())


def test_posting_lists_are_those_of_a_plain_search():
    rng = __import__("random").Random(5)
    texts = ["".join(rng.choices("aBbé ", k=rng.randrange(9))) for _ in range(300)] + ["", "ab", "a", "b"]
    names = [b"abb", b"b a", "éa".encode(), b"zzz"]
    number = __import__("numpy").zeros(1 << 24, "u2")
    for k, n in enumerate(names):
        number[int.from_bytes(n, "big")] = k + 1
    index = sc.TrigramIndex(texts, number, names)
    want = {n: {k for k, t in enumerate(texts) if n in t.encode().lower()} for n in names}
    assert {n: set(index.lists[n].tolist()) for n in names} == want and want[b"abb"]
    both = ("or", frozenset({("and", frozenset({("tri", b"abb"), ("tri", b"b a")})), ("tri", "éa".encode())}))
    assert set(index.answer(both).tolist()) == (want[b"abb"] & want[b"b a"]) | want["éa".encode()]


def test_the_index_leaves_most_texts_unread(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for _, rule, regex, found in sc.Scanner().candidates(texts):
        assert {k for k, t in enumerate(texts) if regex.search(t)} <= set(found)
        assert len(found) == len(texts) if rule.kind == "hex" else len(found) < len(texts) / 10


def test_segments_and_long_texts(monkeypatch):
    texts = [*TEXTS, "x" * 5000 + " token = abcdef", None] * 3
    whole = sc.Scanner().spans([t or "" for t in texts])
    monkeypatch.setattr(sc, "SEGMENT", 40)
    assert sc.Scanner().spans([t or "" for t in texts]) == whole and sc.Scanner().spans([]) == []


def test_query_columns_against_brute_force(spark, tmp_path, odd):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[1] + " " + TEXTS[8])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sc.query(spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        base = brute(t)
        n = [sum(x.startswith(k + ":") for x in base) for k, *_ in BASE]
        more = [(m.start(), k, f"{r.kind}:{m.start()}:{m.end()}") for k, r in enumerate(sc.RULES) if not r.base for m in re.finditer(r.pattern, t or "")]
        order = [(int(x.split(":")[1]), [r.kind for r in sc.RULES].index(x.split(":")[0]), x) for x in base]
        want.append((d, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(x for *_, x in sorted(order + more))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_odd_rows(odd, empty):
    assert sc.scan_secrets(odd).count() == odd.count() and sc.scan_secrets(empty).count() == 0
    assert sc.redact_secrets(odd).exceptAll(odd).count() == 0  # nothing to mask: rows stay as they are
    assert sc.redact_secrets(empty).columns == empty.columns


def test_masking(spark):
    df = spark.createDataFrame([(1, "a password=hunter22 b " + "AKIA" + "C" * 20, 0)], "doc_id long, text string, n_chars long")
    row = sc.redact_secrets(df).first()
    assert row["text"] == "a [ASSIGN] b [ACCESS]" and row["n_chars"] == len(row["text"])
    assert sc.scan_secrets(sc.redact_secrets(df)).where(F.size("spans") > 0).count() == 0
