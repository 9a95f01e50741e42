"""Encoder, token store and packing: exact round trips."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import packing, token_store
from quern.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_cached_encoding_is_the_tokenizers(plain, documents):
    texts = [r["text"] for r in documents.collect()] + [None, "", " ", "  a  b\n c ", "x ", " x", "don't stop's <|endoftext|> a", "日本語 text", "a  b", "\n\n a", "é. ªº x²³ ¼", "a\x0b b", "12 345,6 'll", " a"]
    got = Encoder(most=200).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t) for t in texts]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, token_store.BLOCK, token_store.BLOCK + 3])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    sizes, data = token_store.encode_ids(ids, planes)
    assert (token_store.decode_ids(n, sizes, data, planes) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_store_round_trip(spark, odd, plain, tmp_path, planes):
    path = token_store.write_store(odd, str(tmp_path / "s"), planes=planes)
    rows = sorted(((r["doc_id"], r["start"], r["ids"]) for r in token_store.read_store(spark, path).collect()), key=lambda r: r[1])
    want = sorted(((r["doc_id"], [*plain(r["text"]), 0]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))
    assert sorted(map(str, ((d, i) for d, _, i in rows))) == sorted(map(str, want))
    assert [s for _, s, _ in rows] == list(np.cumsum([0, *(len(i) for _, _, i in rows)])[:-1])
    known = [d for d, _, _ in rows if d is not None]
    assert known == sorted(known)


def test_empty_store(spark, empty, tmp_path):
    assert token_store.read_store(spark, token_store.write_store(empty, str(tmp_path / "e"))).count() == 0


def check_packing(df, plain, length=2048):
    want = {}
    for r in df.collect():
        want.setdefault(r["doc_id"], []).append([*plain(r["text"]), 1])
    rows = packing.pack(df, length=length).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        cover = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[d])
        exp = sorted((s, min(length, len(i) - s), zlib.crc32(np.array(i[s : s + length], "<u4").tobytes()), len(i)) for i in ids for s in range(0, len(i), length))
        assert cover == exp
    for places in by_seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return sum(r["length"] for r in rows), len(by_seq) * length


def test_packing_documents(documents, plain):
    used, room = check_packing(documents, plain)
    assert 1 - used / room < 0.03


def test_packing_odd_rows(odd, empty, plain):
    check_packing(odd, plain)
    assert packing.pack(empty).count() == 0


def first_fit(items, room):
    left = []
    for x in sorted(items, reverse=True):
        at = next((k for k, r in enumerate(left) if r >= x), None)
        if at is None:
            left.append(room - x)
        else:
            left[at] -= x
    return len(left)


def test_cutting_stock_beats_first_fit():
    rng = np.random.default_rng(2)
    for n in (1, 5, 400, 5000):
        items = rng.integers(1, 65, n)
        count = np.bincount(items, minlength=65)
        sizes = np.flatnonzero(count)
        plan = packing.solve(sizes, count[sizes], 64)
        assert (sum(p * k for p, k in plan) == count[sizes]).all() and all((p * sizes).sum() <= 64 for p, _ in plan)
        assert sum(k for _, k in plan) <= first_fit(items.tolist(), 64) + 3
    thirds = packing.solve(np.array([21, 22]), np.array([2000, 1000]), 64)  # two of one and one of the other fill a sequence
    assert sum(k for _, k in thirds) <= 1002
    assert packing.solve(np.zeros(0, int), np.zeros(0, int), 64) == []


def test_a_file_of_another_kind_is_encoded_by_the_library():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t, codec = Tokenizer.from_file(path), Encoder(path)
    texts = ["Some words, don't  stop", "", None, "日本語 é"]
    assert not codec.by_cuts and Encoder().by_cuts
    assert [np.frombuffer(g, "<u4").tolist() for g in codec.encode(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_documents_through_the_index(spark, documents, plain, tmp_path):
    path = token_store.write_store(documents, str(tmp_path / "s"))
    some = {r["doc_id"]: r["text"] for r in documents.where("doc_id % 7 = 3").collect()}
    got = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, path, [*some, 10**9]).collect()}
    assert got == {d: [*plain(t), 0] for d, t in some.items()}
    assert token_store.read_documents(spark, path, [10**9]).count() == 0


def test_store_query_columns(spark, odd, plain, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in token_store.query(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    want, at = [], 0
    for d, t in sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*plain(t), 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def padding(df, length=2048):
    rows = df.select("sequence_id", "length", "offset").collect()
    ends = {}
    for r in rows:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert sum(r.length for r in rows) == sum(ends.values()) and max(ends.values()) <= length
    return 1 - sum(ends.values()) / (len(ends) * length)


def test_binary_parts():
    for n in range(1, 2048):
        cut = packing.binary_parts(7, n, 2048, 16)
        assert cut[0][0] == 7 and sum(k for _, k in cut) == n and all(a + k == b for (a, k), (b, _) in zip(cut, cut[1:]))
        assert all(k & (k - 1) == 0 for _, k in cut[:-1]) and (cut[-1][1] < 16 or cut[-1][1] & (cut[-1][1] - 1) == 0)


@pytest.mark.parametrize("kind", ["1025", "1040", "700", "10", "1..40", "5..100", "log-normal", "63"])
def test_packing_pads_little_at_any_length(spark, plain, kind):
    """A text of n words that are one id each gives n + 1 ids."""
    rng = np.random.default_rng(4)
    lengths = {"1025": [1024] * 400, "1040": [1039] * 400, "700": [699] * 500, "10": [9] * 40_000, "63": [62] * 12_000, "1..40": rng.integers(0, 40, 20_000), "5..100": rng.integers(4, 100, 6000), "log-normal": np.minimum(rng.lognormal(4.3, 0.7, 5000), 4000).astype(int)}[kind]
    df = spark.createDataFrame([(i, " the" * int(n)) for i, n in enumerate(lengths)], "doc_id long, text string").repartition(4)
    out = packing.pack(df).cache()
    assert out.agg({"length": "sum"}).first()[0] == sum(int(n) + 1 for n in lengths)
    assert padding(out) < 0.01
    ids = dict(enumerate(plain(" the" * int(n)) + [1] for n in lengths[:100]))
    seen = {}
    for r in out.where("doc_id < 100").collect():
        want = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(want), len(ids[r.doc_id]))
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, cuts in seen.items():
        assert [a for a, _ in sorted(cuts)] == [sum(k for _, k in sorted(cuts)[:i]) for i in range(len(cuts))] and sum(k for _, k in cuts) == len(ids[d])
