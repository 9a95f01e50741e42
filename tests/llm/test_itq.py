import numpy as np

from quern.llm import itq


def brute(rows, threshold=0.95):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {}
    for i in ok:
        v = np.array([float(x) for x in rows[i][1]]) / max(abs(x) for x in rows[i][1])
        unit[i] = v / np.linalg.norm(v)
    near = {i: [j for j in ok if j != i and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold] for i in ok}
    out, done = [], {}
    for i in ok:
        if i in done:
            continue
        todo, seen = [i], {i}
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        done |= dict.fromkeys(seen, min(rows[j][0] for j in seen))
    for i, (k, _) in enumerate(rows):
        c = done.get(i, k)
        out.append((k, len(near.get(i, [])), c, True if i not in done else k == c))
    return sorted(out, key=str)


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(n)]
    for i in range(0, n, 4):  # groups of near copies around every fortieth vector
        c = np.array(rows[i - i % 40][1])
        rows[i] = (i, (c + rng.normal(scale=0.02 + 0.1 * (i % 8 == 0), size=16)).tolist())
    rows += [(n + i, rows[0][1]) for i in range(5)] + [(n + 10, [2 * x for x in rows[0][1]])]
    rows += [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [1.0] * 3), (906, []), (None, rows[0][1]), (0, rows[0][1])]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, rep int, t int"), rows


def test_links_components_and_odd_rows(spark):
    df, rows = table(spark)
    want = brute(rows)
    for block in (4096, 8):
        got = sorted(map(tuple, itq.near_duplicates(df, recall=0.9999, block=block).collect()), key=str)
        assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want) and len(got) == len(want)
        assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_lengths_and_magnitudes(spark):
    """Each length links within itself; rows far too small or large for their squares to be held link as others do."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 8))
    rows = [(i, v) for i, v in enumerate(base.tolist())]
    rows += [(100 + i, [1e-200 * x for x in v]) for i, v in enumerate(base[:5].tolist())] + [(110 + i, [1e200 * x for x in v]) for i, v in enumerate(base[:5].tolist())]
    rows += [(120, [5e-324] + [0.0] * 7), (121, [1.7e308] * 8), (122, [1.0] + [0.0] * 7), (123, [2.0] * 8)]
    rows += [(200 + i, [1.0, 2.0, 3.0]) for i in range(2)] + [(202, [1.0, 2.0, 3.1]), (203, [-1.0, 2.0, 3.0]), (204, [7.0]), (205, [1e-300]), (206, [-7.0])]
    rows += [(300 + i, v) for i, v in enumerate(rng.normal(size=(30, 12)).tolist())] + [(340, rows[-1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    for block in (4096, 8):
        assert sorted(map(tuple, itq.near_duplicates(df, recall=0.9999, block=block).collect()), key=str) == want


def test_a_dense_cluster_has_exact_counts(spark):
    """Over 1000 different vectors, nearly all linked with all, in lists far longer than the limit."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=64) + rng.normal(scale=0.12, size=(1200, 64)), rng.normal(size=(300, 64))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(df, block=200).collect()}
    have = np.array([got[i] for i in range(len(x))])
    assert want.max() > 1000 and (have <= want).all() and have.sum() >= 0.99 * want.sum()


def test_empty_and_unusable(spark):
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, itq.near_duplicates(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_on_whole_table(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.4).sum() - len(x))
    got = sum(r["n_links"] for r in itq.near_duplicates(df, threshold=0.4).collect())
    assert want and 0.9 * want <= got <= want


def test_codes_are_balanced():
    x = np.random.default_rng(0).normal(size=(2000, 16))
    mean, p = itq.learn_codes(x, 40)
    share = ((x - mean) @ p >= 0).mean(0)
    assert p.shape == (16, 40) and (abs(share - 0.5) < 0.1).all()


def test_recall_on_uneven_and_off_centre_vectors(spark):
    """64 dimensions with deviations from 1 down to the given one around a mean, and pairs at cosine 0.95 or little more."""
    rng = np.random.default_rng(6)
    for least, shift in ((0.15, 0.0), (0.002, 0.0), (0.15, 0.5), (0.023, 0.3)):
        x = rng.normal(size=(5000, 64)) * np.geomspace(1, least, 64) + shift
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        noise = rng.normal(size=(2000, 64))
        noise -= (noise * x[:2000]).sum(1, keepdims=True) * x[:2000]
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        c = rng.uniform(0.9501, 0.96, (2000, 1))
        x = np.vstack([x, c * x[:2000] + np.sqrt(1 - c**2) * noise])
        want = int((x @ x.T >= 0.95).sum() - len(x))
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        got = {r["vec_id"]: r for r in itq.near_duplicates(df).collect()}
        assert 0.97 * want <= sum(r["n_links"] for r in got.values()) <= want
        assert sum(got[i]["component_id"] == got[5000 + i]["component_id"] for i in range(2000)) >= 0.97 * 2000
