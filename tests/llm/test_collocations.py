"""Phrase collocations against counting in plain Python."""
import functools
import gc
import re
import weakref
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from quern.llm import batches, collocations


def brute(rows, least, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = {}
    for text, lang in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            gone |= {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * c[p[i : i + k]]}
        kept = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(v for p, v in c.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("range_keys", [200, collocations.RANGE_KEYS])
def test_documents_as_counted_in_python(spark, documents, monkeypatch, range_keys):
    monkeypatch.setattr(collocations, "phrase_counts", lambda d, n, s, f=collocations.phrase_counts: f(d, n, s, range_keys))
    want = brute([(r.text, r.lang) for r in documents.select("text", "lang").collect()], 10)
    assert want and rows_of(collocations.collocations(documents, least=10)) == want


def test_ranks_and_ties_end_at_the_limit(spark, documents):
    rows = [(r.text, r.lang) for r in documents.select("text", "lang").collect()]
    assert rows_of(collocations.collocations(documents, least=10, top=3)) == brute(rows, 10, 3)


def test_odd_rows_empty_tables_and_breaks(spark, odd, empty):
    texts = ["A b, c d e", "a\tB  c.d", "x x x x x", "é É é É", "a b\x0bc d e f", ". , ;", "\x85a b c d", "a b c d e"]
    rows = [(i, t, (None, "en")[i % 2]) for i in range(40) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(odd.select("doc_id", "text", "lang"))
    want = brute([(r.text, r.lang) for r in df.collect()], 5)
    assert rows_of(collocations.collocations(df, least=5)) == want
    assert rows_of(collocations.collocations(odd, least=2)) == brute([(r.text, r.lang) for r in odd.collect()], 2)
    assert collocations.collocations(empty).collect() == []


def test_keys_and_blocks():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, 5000) * rng.choice([1, 1 << 30], 5000)
    hi, lo = collocations.pack(ids)
    want = Counter()
    for i in range(len(ids) - 1):
        if ids[i] and ids[i + 1]:
            run = [int(x) for x in ids[i : i + 4]] + [0] * 4
            run = run[: run.index(0)][:4]
            want[tuple(run + [0] * (4 - len(run)))] += 1
    hi, lo, n = collocations.run_lengths(hi, lo)
    got = {(int(a) >> 32, int(a) & 0xFFFFFFFF, int(b) >> 32, int(b) & 0xFFFFFFFF): int(k) for a, b, k in zip(hi, lo, n)}
    assert got == want and list(got) == sorted(got)
    back = collocations.from_block(collocations.to_block(hi, lo, n))
    assert all((x == y).all() for x, y in zip(back, (hi, lo, n)))


def test_batches_give_their_texts_back(spark, odd):
    got = Counter()
    for r in batches.code_batches(odd, collocations.words_and_breaks, "lang", most_bytes=20_000).collect():
        for doc_id, codes in zip(r["ids"], r["codes"]):
            got[doc_id, tuple(b"." if c == 0 else r["words"][c - 1].encode() for c in codes)] += 1
        assert list(np.bincount(np.concatenate([np.array(c) for c in r["codes"]]), minlength=len(r["words"]) + 1)[1:]) == r["counts"]
    assert got == Counter((r.doc_id, tuple(collocations.words_and_breaks(r.text or ""))) for r in odd.collect())


def test_batches_go_without_a_search_for_circles():
    gc.disable()
    try:
        batch = batches._Batch()
        batch.add(1, "en", [b"a", b"b", b"a", b"."], 7)
        gone = weakref.ref(batch)
        assert batch.row(0).column("counts")[0].as_py() == [2, 1]
        del batch
        assert gone() is None
    finally:
        gc.enable()


def test_ranges_are_even_beyond_the_keys_that_one_batch_shows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = " ".join(f"w{k}" for k in rng.integers(0, 60, 4000))
    dealt = []
    monkeypatch.setattr(collocations, "_deal", lambda blocks, bounds, f=collocations._deal: dealt.append(f(blocks, bounds)) or dealt[0])
    monkeypatch.setattr(collocations.Scratch, "drop", lambda *a: None)
    df = spark.createDataFrame([(k, text, "en") for k in range(12)], "doc_id long, text string, lang string").repartition(12, "doc_id")
    monkeypatch.setattr(collocations, "code_batches", functools.partial(batches.code_batches, most_bytes=1000))
    _, phrases, _ = collocations.phrase_counts(df, least=2, range_keys=50)
    sizes = Counter()
    for r in dealt[0].collect():
        sizes[r["range"]] += len(collocations.from_block(r["block"])[0])
    assert sum(sizes.values()) > 40_000 and max(sizes.values()) <= 150
    words = text.split()
    assert phrases.count() == sum(len(set(zip(*(words[i:] for i in range(k))))) for k in (2, 3, 4))


def test_tables_of_batches_have_a_row_group_each(spark, documents, monkeypatch):
    kept = []
    monkeypatch.setattr(collocations.Scratch, "drop", lambda self, *frames: kept.extend(frames))
    monkeypatch.setattr(collocations, "code_batches", functools.partial(batches.code_batches, most_bytes=20_000))
    collocations.phrase_counts(documents.coalesce(2), least=10)
    for df in kept:
        files = [pq.ParquetFile(f.removeprefix("file://")) for f in df.inputFiles()]
        assert all(f.metadata.row_group(k).num_rows == 1 for f in files for k in range(f.num_row_groups))
    assert kept[0].count() > 2 * len(kept[0].inputFiles())
