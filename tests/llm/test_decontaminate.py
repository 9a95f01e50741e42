import re
from collections import Counter

import numpy as np

from quern.llm import decontaminate as dc


def brute(text, item, least=0.8):
    w, i = (re.findall(r"\w+", (t or "").lower()) for t in (text, item))
    if not w or not i:
        return False
    k, n = min(5, len(i)), len(i)
    grams = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
    want = grams(i)
    for s in range(max(1, len(w) - n + 1)):
        got = grams(w[s : s + n])
        if got and sum((got & want).values()) / sum((got | want).values()) >= least:
            return True
    return False


def test_documents(spark, documents, tiny):
    items = spark.read.parquet(f"{tiny}/benchmark.parquet")
    docs, tasks = documents.collect(), items.collect()
    some = [d for d in docs if len(d["text"] or "") < 6000]
    want = {(d["doc_id"], t["item_id"]) for d in some for t in tasks if set(re.findall(r"\w+", t["text"].lower())) and brute(d["text"], t["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(documents, items).collect()}
    assert want and {g for g in got if g[0] in {d["doc_id"] for d in some}} == want
    small = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(documents, items, block=7).collect()}
    assert small == got
    left = {r["doc_id"] for r in dc.drop_leaks(documents, items).collect()}
    assert left == {d["doc_id"] for d in docs} - {g[0] for g in got}


def test_near_copies_short_items_and_odd_rows(spark, odd, empty):
    words = [f"w{i}" for i in range(70)]
    item, near, far = " ".join(words), " ".join(words[:30] + ["X"] + words[31:]), " ".join(words[:20] + ["X", "Y", "Z"] + words[40:])
    items = spark.createDataFrame([(1, item), (2, "alpha beta"), (3, ""), (4, None), (5, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "pre " + near + " post"), (2, far), (3, "an alpha, Beta!"), (4, item.upper()), (5, "beta alpha"), (6, None), (7, "one two three four"), (8, near), (8, near)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect())
    assert got == [(1, 1), (3, 2), (4, 1), (8, 1), (8, 1)]
    assert [brute("pre " + near, item), brute(far, item)] == [True, False]
    assert dc.find_leaks(odd, items).count() == 0 and dc.find_leaks(empty, items).count() == 0
    assert dc.find_leaks(odd, items.limit(0)).count() == 0
    assert dc.drop_leaks(odd, items).count() == odd.count()


def pairs(found):
    return set(zip(*(x.tolist() for x in found), strict=True))


def test_hamming_blocks_miss_nothing_and_select():
    """Every pair within the radius meets; of unrelated pairs less than a fifth do, and the whole distance leaves none."""
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (50, dc.BITS))
    asked = np.array([bits[i % 50] for i in range(300)])
    for i in range(300):
        asked[i, rng.choice(dc.BITS, i % 75, replace=False)] ^= 1
    packed = lambda x: np.packbits(x, axis=1).view(">u2").astype(np.uint16)
    index = dc.HammingIndex(packed(bits), 63)
    want = {(i, j) for i in range(300) for j in range(50) if (asked[i] != bits[j]).sum() <= 63}
    assert pairs(index.search(packed(asked))) == want and len(want) > 200
    assert pairs(index.search(packed(asked), 7)) == want
    met = index.meet(packed(rng.integers(0, 2, (400, dc.BITS))))
    assert 0.1 < len(met[0]) / (400 * 50) < 0.2 and not len(index.search(packed(rng.integers(0, 2, (400, dc.BITS))))[0])


def test_window_fingerprints_are_those_of_the_windows():
    rng = np.random.default_rng(6)
    for letters in (10**9, 30):  # without and with shingles that occur again
        s = rng.integers(0, letters, 500).astype(np.uint64)
        starts = np.sort(rng.integers(0, 400, 200))
        sizes = rng.integers(1, 100, 200)
        order = np.lexsort((sizes, starts))
        got = dc.window_fingerprints(s, starts[order], sizes[order], most=64)
        assert all((g == dc.fingerprint(s[a : a + n])).all() for g, a, n in zip(got, starts[order], sizes[order], strict=True))


def test_similar_texts_have_fingerprints_within_the_radius():
    """Windows at a weighted similarity of 0.8 to 0.85, with shingles that occur often in one of the two only."""
    rng, far = np.random.default_rng(9), 0
    for n in (9, 20, 60, 400):
        for _ in range(100):
            item = rng.integers(0, 2**63, n).astype(np.uint64)
            window, k = item.copy(), int(n / 9)  # k of n others: (n - k) / (n + k) >= 0.8
            window[rng.choice(n, k, replace=False)] = rng.integers(0, 2**63, dtype=np.uint64) if rng.random() < 0.5 else rng.integers(0, 2**63, k).astype(np.uint64)
            far += int(np.bitwise_count(dc.fingerprint(item) ^ dc.fingerprint(window)).sum()) > 63
    assert far == 0


def test_repeated_shingles_and_a_long_text(spark):
    item = " ".join(["tick tock"] * 20 + [f"w{i}" for i in range(40)])
    edited = " ".join(["tick tock"] * 20 + [f"w{i}" for i in range(38)] + ["x", "y"])
    filler = " ".join(f"f{i % 997}" for i in range(200_000))
    rows = [(1, item), (2, edited), (3, "tick tock " * 500), (4, f"{filler} {edited} {filler}"), (5, " ".join(f"w{i}" for i in range(40)))]
    items = spark.createDataFrame([(1, item), (2, "tick tock " * 30)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 1, 199_998)]  # two words before it share as much as the two at its end
    assert [brute(t, "tick tock " * 30) for _, t in rows[:3]] == [False, False, True]


def test_query_columns_and_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three four five six", 5, 0.1), (None, "one two three four five six seven", 6, 0.2)], "doc_id long, text string, item_id int, similarity double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = dc.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "item_id", "similarity", "first_word"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 7, 1.0, 0), (None, 7, 1.0, 0)]
