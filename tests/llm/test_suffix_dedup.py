import hashlib
import os

import numpy as np

from quern.llm import suffix_dedup as sd

from .conftest import sentence


def brute(rows, n=50):
    """Every string of n bytes, by its least document."""
    first: dict[bytes, int] = {}
    for d, t in rows:
        if d is not None:
            for i in range(len(t) - n + 1):
                first[t[i : i + n]] = min(d, first.get(t[i : i + n], d))
    out = []
    for d, t in rows:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1) if d is not None else ():
            if first[t[i : i + n]] < d:
                mask[i : i + n] = True
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        out.append((d, len(t), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(df):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    assert sorted(map(tuple, sd.remove_repeats(df).collect()), key=str) == brute(rows)


def test_documents(documents):
    check(documents)


def test_odd_rows(odd, empty):
    check(odd)
    assert sd.remove_repeats(empty).count() == 0


def test_passages_in_other_surroundings(spark):
    """A passage many documents share between other words; runs of one byte; zeros; texts that end in a match."""
    p = sentence(9, 40)
    rows = [(i, f"{sentence(i, 15)} {p[i % 7 :]} {sentence(i + 500, 15)}") for i in range(60)]
    rows += [(100, "a" * 200), (101, "b" + "a" * 120), (102, "ab" * 80), (103, "ab" * 30), (104, "\0" * 130), (105, "x" + "\0" * 70), (106, p[10:]), (107, p[:60]), (108, p[:49]), (109, p[-50:]), (110, p[20:90] + p[20:90])]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    around = rng.integers(97, 99, (40, sd.SIDE + sd.L)).astype(np.uint8)
    around[5:20] = around[0]
    around[20:30, 7:70] = around[1, 7:70]
    suffixes, (i, j) = sd.Suffixes(around), np.nonzero(np.ones((40, sd.SIDE + 1), bool))
    order = suffixes.order(i, j, i)
    i, j = i[order], j[order]
    got = [bytes(around[x, y : y + sd.L]) for x, y in zip(i, j, strict=True)]
    assert got == sorted(got)
    lcp = suffixes.common(i, j).tolist()
    assert lcp[0] == 0 and lcp[1:] == [len(os.path.commonprefix([x, y])) for x, y in zip(got, got[1:], strict=False)]


def test_longest_previous_factors():
    """Against the definition, over suffix orders of random texts with many ties of document and prefix."""
    rng = np.random.default_rng(4)
    for n, letters, docs in ((1, 2, 1), (60, 2, 5), (80, 3, 80), (50, 1, 10)):
        texts = ["".join(chr(97 + c) for c in rng.integers(0, letters, 12)) for _ in range(n)]
        doc = rng.integers(0, docs, n)
        order = sorted(range(n), key=lambda k: (texts[k], doc[k]))  # noqa: B023
        texts, doc = [texts[k] for k in order], doc[order]
        shared = lambda x, y: len(os.path.commonprefix([texts[x], texts[y]]))  # noqa: B023, E731
        lcp = np.array([0, *(shared(k - 1, k) for k in range(1, n))])
        want = [max((shared(x, y) for y in range(n) if doc[y] < doc[x]), default=0) for x in range(n)]
        assert sd.previous_factors(doc, lcp).tolist() == want
        assert sd.previous_factors(doc, lcp, 5).tolist() == [w if w >= 5 else 0 for w in want]


def test_one_byte_for_a_megabyte_has_few_anchors_and_goes_whole(spark):
    assert len(sd.anchors([b"a" * 1_000_000])[0][0]) < 200
    rows = [(1, "x" + "a" * 60), (2, "b" * 100_000 + "a" * 1_000_000 + "c"), (3, "b" * 70 + "é" * 50_000), (4, "a" * 49 + "b" * 49), (5, "é" * 26)]
    got = {r["doc_id"]: r for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[k]["n_removed"], got[k]["n_spans"]) for k in range(1, 6)] == [(0, 0), (1_000_000, 1), (70, 1), (0, 0), (52, 1)]
    assert got[2]["kept_sha256"] == hashlib.sha256(b"b" * 100_000 + b"c").hexdigest()


def test_many_copies_of_one_row(spark):
    text = sentence(3, 40)
    rows = [(1, text)] * 5000 + [(2, text)] * 5000 + [(None, text)] * 10
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 5000), (2, len(text), 5000), (None, 0, 10)], key=str)


def test_outer_bytes_of_a_shared_passage_tell_surroundings_apart(spark):
    """Of 20,000 documents around one passage, some agree in 24 bits of their surroundings' hash, and none in all."""
    rng = np.random.default_rng(8)
    outer = rng.integers(97, 123, (20_000, 60)).astype(np.uint8)
    anchor = lambda p: sd.anchors([p])[0][1]
    p = next(p for p in (sentence(k, 40).encode()[:62] for k in range(100)) if (abs(anchor(p) - 21) <= 6).all())  # 15 bytes to both sides in the passage
    rows = [(i, (bytes(o[:30]) + p + bytes(o[30:])).decode()) for i, o in enumerate(outer)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_pieces_of_a_text_have_its_anchors(monkeypatch):
    texts = [sentence(k, 300).encode() for k in range(3)] + [b"a" * 700]
    found = lambda: {tuple(int(v) for v in r) for x in sd.anchors(texts) for r in zip(*x, strict=True)}
    whole = found()
    monkeypatch.setattr(sd, "BLOCK", 333)
    assert found() == whole and max(r[1] for r in whole) > 333


def test_text_above_16_mb(spark):
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(97, 123, 17 << 20).astype(np.uint8))
    cuts = [(5, 90), ((1 << 20) - 40, 100), ((16 << 20) + 77, 60)]
    rows = [(k, long[at : at + n].decode()) for k, (at, n) in enumerate(cuts)] + [(9, long.decode())]
    got = {r["doc_id"]: r for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[9]["n_removed"], got[9]["n_spans"]) == (250, 3)
    kept = long[:5] + long[95 : cuts[1][0]] + long[cuts[1][0] + 100 : cuts[2][0]] + long[cuts[2][0] + 60 :]
    assert got[9]["kept_sha256"] == hashlib.sha256(kept).hexdigest() and all(got[k]["n_removed"] == 0 for k in range(3))
