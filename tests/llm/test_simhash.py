import re

import numpy as np
import xxhash

from quern.llm import simhash as sh
from quern.llm.common import Scratch
from quern.llm.graph import components


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    """items: (id, value); the least id reachable, by plain search."""
    out, left = {}, list(range(len(items)))
    while left:
        todo, seen = [left[0]], {left[0]}
        while todo:
            i = todo.pop()
            for j in left:
                if j not in seen and linked(items[i][1], items[j][1]):
                    seen.add(j)
                    todo.append(j)
        least = min((items[i][0] for i in seen if items[i][0] is not None), default=None)
        out |= {i: least for i in seen}
        left = [i for i in left if i not in seen]
    return [(*items[i], out[i]) for i in range(len(items))]


def check(df):
    rows = [(r["doc_id"], brute_print(r["text"])) for r in df.collect()]
    want = sorted(brute_components(rows, lambda a, b: (a ^ b).bit_count() <= 3), key=str)
    got = sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in sh.near_duplicates(df).collect()), key=str)
    assert got == want


def test_documents(documents):
    check(documents)


def test_odd_rows(odd, empty):
    check(odd)
    assert sh.near_duplicates(empty).count() == 0


def test_no_link_is_lost_in_dense_sets(spark):
    """Every fingerprint within a small ball, with lists longer than the limit."""
    rng = __import__("random").Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(150)})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for hot in (2048, 3):
        scratch = Scratch(spark, "test")
        label = {r["node"]: r["label"] for r in components(scratch.write(sh.fingerprint_links(df, scratch, hot=hot)), scratch).collect()}
        got = {}
        for s, v in zip(signed, values, strict=True):
            got.setdefault(label.get(s, s), set()).add(v)
        want = {}
        for v, _, least in brute_components([(v, v) for v in values], lambda a, b: (a ^ b).bit_count() <= 3):
            want.setdefault(least, set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_the_tally_keeps_what_shares_enough_bytes():
    """Candidates are exactly the members with at least five bytes (thirteen half bytes) in common, and hold all within the radius."""
    rng = np.random.default_rng(2)
    for fixed in (3, 5, 7):
        fps = np.unique(rng.integers(0, 4, (400, 8)).astype(np.uint8) * np.uint8(65), axis=0)
        fps[:, :fixed] = 9
        if fixed > 3:
            fps[:, fixed:] = rng.integers(0, 256, (len(fps), 8 - fixed))
        fps = np.unique(fps, axis=0)
        values = np.ascontiguousarray(fps).view(np.uint64).ravel()
        index = sh.Postings(values, 3)
        half = np.concatenate([fps >> 4, fps & 15], axis=1)
        for k in range(0, len(values), 7):
            shared = (fps == fps[k]).sum(1) >= 5 if fixed == 3 else (half == half[k]).sum(1) >= 13
            near = np.bitwise_count(values ^ values[k]) <= 3
            assert set(index.candidates(k).tolist()) == set(np.flatnonzero(shared).tolist()) and not (near & ~shared).any()
        assert any(len(index.candidates(k)) < len(values) / 2 for k in range(len(values))) or fixed == 7


def test_query_columns_against_brute_force(spark, tmp_path, odd):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], brute_print(r["text"])) for r in odd.collect()]
    want = sorted(((d, f"{fp:016x}", c) for d, fp, c in brute_components(rows, lambda a, b: (a ^ b).bit_count() <= 3)), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in sh.query(spark, str(tmp_path)).collect()), key=str) == want


def test_components_of_a_chain(spark):
    scratch = Scratch(spark, "chain")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    label = {r["node"]: r["label"] for r in components(edges, scratch).collect()}
    assert len({label[i] for i in range(41)}) == 1 and label[100] == label[101] != label[0]
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def test_first_of_each_group_stays(odd):
    kept = sh.keep_first(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert 1 in ids and 5 not in ids and 6 not in ids and len(ids) == len(set(ids)) and kept.where("doc_id is null").count() == 2
