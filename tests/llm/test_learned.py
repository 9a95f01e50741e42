"""Toxicity, language identification and the language model: held-out quality and exact parts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hmm, langid, toxicity


def rest(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def larger(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_toxicity_on_held_out_rows(larger):
    docs, labels = larger
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.score_toxicity(docs, labels).collect()]
    assert all(r["held_out"] == (rest(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"] >= 0.7, truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hit = sum(p and y for p, y in held)
    assert hit >= 0.8 * sum(y for _, y in held) and hit >= 0.95 * sum(p for p, _ in held)


@pytest.fixture(scope="module")
def restorer(documents):
    counts = np.zeros(toxicity.SIZE**3, np.int64)
    toxicity.count_trigrams([r["text"] or "" for r in documents.collect()] + ["the stupid idiot was a moron and worthless trash"] * 50, counts)
    return toxicity.Restorer(toxicity.CharModel(counts))


@pytest.mark.parametrize(("seen", "meant"), [("1d10t", "idiot"), ("$tupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("stuuuupid", "stupid"), ("m0r0n!!!", "moron"), ("tr4sh***", "trash")])
def test_words_are_restored(restorer, seen, meant):
    assert meant in restorer(seen)


@pytest.mark.parametrize(("seen", "meant"), [("!d!0t", "idiot"), ("|d10+", "idiot"), ("57up1d", "stupid"), ("!d107", "idiot"), ("70$$", "toss")])
def test_words_of_few_letters_are_restored(seen, meant):
    counts = np.zeros(toxicity.SIZE**3, np.int64)
    toxicity.count_trigrams(["the stupid idiot was a moron to toss worthless trash"] * 50, counts)
    restorer = toxicity.Restorer(toxicity.CharModel(counts))
    assert meant in restorer(seen)
    assert restorer("1,000") == ("1,000",) and restorer("$455") == ("$455",) and restorer("(455)!") == ("455",)


def test_plain_words_stay(restorer):
    assert restorer("the") == ("the",) and restorer("well,") == ("well",) and restorer("...") == ()
    assert "stupid" in restorer.spaced("you are s t u p i d indeed")


def test_toxicity_of_odd_rows(odd, empty, labels):
    assert toxicity.score_toxicity(odd, labels).count() == odd.count() and toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()


def test_languages_on_held_out_rows(larger):
    docs, _ = larger
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    rows = langid.identify(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (rest(r["doc_id"], 3) == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) >= 0.9 * len(held)


def test_languages_of_odd_rows(spark, odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and langid.identify(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        no_letter = r["doc_id"] is not None and not re.search(r"[^\W\d_]", texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == no_letter or r["doc_id"] is None
    nothing = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_folded_tables_give_the_networks_answers():
    rng, net = np.random.default_rng(1), langid.Network(3)
    x = rng.integers(0, langid.SYMBOLS, (20, langid.WINDOW)).astype(np.uint8)
    f = np.maximum(net.maxima(x)[0], 0) @ net.p["V"] + net.p["b"]
    e = np.exp(f - f.max(1, keepdims=True))
    assert np.allclose(langid.Predictor(net.p).probabilities(x), e / e.sum(1, keepdims=True), atol=1e-4)


def test_gradients_by_differences():
    rng, net = np.random.default_rng(2), langid.Network(3)
    x, y = rng.integers(0, langid.SYMBOLS, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        z = np.maximum(net.maxima(x)[0], 0) @ net.p["V"] + net.p["b"]
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(6), y]))

    g = net.gradients(x, y, np.ones(6))
    for name, at in (("V", (3, 1)), ("b", (2,)), ("c3", (1,)), ("W2", (1, 2, 3))):
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        down = loss()
        net.p[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def test_base_scores_and_the_models_gain(documents, odd):
    for df in (documents, odd):
        rows = [(r["doc_id"], words(r["text"])) for r in df.collect()]
        c = Counter(w for d, ws in rows if rest(d, 10) for w in [*ws, None])
        n, v = sum(c.values()), len(c)
        den = math.log10(n + 0.1 * (v + 1))
        want = sorted(((d, rest(d, 10) == 0, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, round(sum(math.log10(c[w] + 0.1) - den for w in [*ws, None]), 4)) for d, ws in rows), key=str)
        got = hmm.score_texts(df, states=4, head=500, sample=100).collect()
        assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == want
    held = [r for r in hmm.score_texts(documents).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_words_outside_the_sample_have_emissions(spark):
    """Four subjects of 150 words each, of which a sample of 12 texts knows a third at most."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{i % 4}x{k}" for k in rng.integers(0, 150, 20))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = [r for r in hmm.score_texts(df, states=4, sample=12).collect() if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in held) > 0.35 * sum(r["n_tokens"] for r in held)
    assert hmm.head_size(5 * 10**9) > 4 * hmm.head_size(10**8) > 4 * 60_000
    wide = np.array([3, 70_000, 65_535])
    assert (hmm.unpack_symbols(hmm.pack_symbols(wide)) == wide).all()


def test_language_model_without_training_rows(spark, empty):
    assert hmm.score_texts(empty).count() == 0
    alone = spark.createDataFrame([(i, "a b") for i in range(200) if rest(i, 10) == 0], "doc_id long, text string")
    rows = hmm.score_texts(alone).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in rows} == {(0, 0)} and all(math.isfinite(r["score"]) for r in rows)


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(3)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    model = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6)]
    for s, got in zip(seqs, model.log10(seqs), strict=True):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert abs(got - math.log10(total)) < 1e-9


def some_model(seed, states, symbols):
    rng = np.random.default_rng(seed)
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T)


def no_counts(states, symbols):
    return np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states), order="F")


def test_expected_counts_are_those_over_all_paths():
    model, rng, want, likelihood = some_model(5, 3, 5), np.random.default_rng(6), no_counts(3, 5), 0.0
    seqs = [rng.integers(0, 5, n) for n in (1, 2, 7, 5, 3)]
    for s in seqs:
        total, mine = 0.0, no_counts(3, 5)
        for path in np.ndindex(*[3] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
            mine[0][path[0]] += p
            for t, z in enumerate(path):
                mine[2][s[t], z] += p
                if t:
                    mine[1][path[t - 1], z] += p
        likelihood += math.log10(total)
        for w, m in zip(want, mine, strict=True):
            w += m / total
    got = no_counts(3, 5)
    assert abs(model.expect(seqs, got) - likelihood) < 1e-9
    assert all(np.allclose(g, w, atol=1e-9) for g, w in zip(got, want, strict=True))


def test_a_long_text_is_cut_nowhere(monkeypatch):
    """Texts beyond SEGMENT in their pool, and one beyond LONG by segments, give what one recursion over each gives."""
    model, rng = some_model(7, 4, 6), np.random.default_rng(8)
    seqs = [rng.integers(0, 6, n) for n in (5000, 1024, 1025, 3, 2048, 4999)]
    want = no_counts(4, 6)
    likelihood = sum(model.expect([s], want) for s in seqs)
    for long, segment, group in ((1 << 17, 1024, 400_000), (900, 64, 700), (900, 1000, 1500)):
        monkeypatch.setattr(hmm, "LONG", long)
        monkeypatch.setattr(hmm, "SEGMENT", segment)
        monkeypatch.setattr(hmm, "GROUP", group)
        got = no_counts(4, 6)
        assert abs(hmm.expect_all(model, iter(seqs), got) - likelihood) < 1e-6
        assert all(np.allclose(g, w, atol=1e-6) for g, w in zip(got, want, strict=True))
        assert abs(model.log10(seqs).sum() - likelihood) < 1e-6


def test_the_likelihood_never_falls():
    """Baum-Welch without smoothing, by the definition, in single and double precision."""
    rng = np.random.default_rng(4)
    seqs = [np.repeat(rng.integers(0, 6, 5), 4) for _ in range(30)]
    for kind, slack in ((np.float64, 1e-9), (np.float32, 1e-3)):
        model, last = some_model(9, 3, 6), -1e9
        for _ in range(15):
            counts = no_counts(3, 6)
            now = hmm.Model(*(x.astype(kind) for x in (model.start, model.move, model.emit))).expect(seqs, counts)
            assert abs(counts[2].sum() - sum(map(len, seqs))) < 1e-2 and abs(counts[0].sum() - 30) < 1e-3
            assert now >= last - slack
            start, move, emit = counts
            last, model = now, hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def test_smoothed_counts_gain_on_the_first_model():
    rng, share = np.random.default_rng(4), np.full(6, 1 / 6)
    seqs = [np.repeat(rng.integers(0, 6, 5), 4) for _ in range(30)]
    model = first = hmm.Model.first(3, share)
    for _ in range(6):
        counts = no_counts(3, 6)
        model.expect(seqs, counts)
        model = hmm.Model.of_counts(*counts, share)
    assert model.log10(seqs).sum() > first.log10(seqs).sum() + 10


def test_tables_are_summed_by_levels(spark):
    rows = [(k, p, hmm.zstandard.ZstdCompressor().compress(np.full(hmm.PART * 2, k + p, "<f4").tobytes())) for k in range(70) for p in (0, 1)]
    df = spark.createDataFrame(rows, "task int, part int, table binary").repartition(70, "task")
    out = hmm._sum_table(df, hmm.PART + 5, 2, fan=4)
    assert out.shape == (hmm.PART + 5, 2) and (out[: hmm.PART] == sum(range(70))).all() and (out[hmm.PART :] == sum(range(70)) + 70).all()


def test_decoding_is_the_best_of_all_paths():
    """Viterbi against every path through the lattices of short tokens."""
    counts = np.zeros(toxicity.SIZE**3, np.int64)
    toxicity.count_trigrams(["the stupid idiot was a moron to toss worthless trash"] * 20, counts)
    model = toxicity.CharModel(counts)
    classes = lambda ch: int(toxicity.CLASSES[min(ord(ch), len(toxicity.CLASSES) - 1)])

    def paths(token, i):
        if i == len(token):
            yield "", 0.0
            return
        for step, out, cost in model._arcs(token, i):
            for rest_, more in paths(token, i + step):
                yield out + rest_, cost + more

    def value(text, cost):
        a = b = 0
        for c in [*map(classes, text), 0]:
            cost, a, b = cost - float(model.log[a, b, c]), b, c
        return -cost

    for token in ("1d10t", "$tup1d", "s.t.u", "moooo0n", "7r4$h!", "a1|", "t0 s5", "x", "!!", "€3é"):
        found = {}
        for text, cost in paths(token, 0):
            found[text] = max(found.get(text, -1e9), value(text, cost))
        assert found[model.decode(token)] >= max(found.values()) - 1e-5


def test_toxicity_query_columns(spark, tmp_path, odd, labels):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    labels.unionByName(spark.createDataFrame([(1, None, 1), (5, 1, None), (None, 0, 1), (5, 0, 1)], labels.schema)).write.parquet(str(tmp_path / "labels.parquet"))
    rows = toxicity.query(spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() and all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 and r["held_out"] == (rest(r["doc_id"], 3) == 1) for r in rows)


def test_language_query_is_the_mean_over_a_texts_windows(spark, tmp_path, odd, documents):
    """Against the network itself, window by window, for whole texts."""
    docs = documents.limit(60).unionByName(odd.select(documents.columns))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    classes, p = langid.train(read.where(~langid.held_out_third(F.col("doc_id"))).select("doc_id", "text", "lang"), 3000)
    net = langid.Network(len(classes))
    net.p = p
    want = []
    for r in read.collect():
        lang, score = "und", 0.0
        if re.search(r"[^\W\d_]", r["text"] or ""):
            data = langid.BYTES[np.frombuffer(r["text"].encode(), np.uint8)]
            total = np.zeros(len(classes))
            for lo in range(0, len(data), langid.WINDOW):
                piece = data[lo : lo + langid.WINDOW]
                x = np.zeros((1, langid.WINDOW), np.uint8)
                x[0, : len(piece)] = piece
                z = (np.maximum(net.maxima(x)[0], 0) @ p["V"] + p["b"])[0]
                e = np.exp(z - z.max())
                total += len(piece) * e / e.sum()
            lang, score = classes[int(total.argmax())], float(total.max() / total.sum())
        want.append((r["doc_id"], rest(r["doc_id"], 3) == 1, lang, round(score, 3)))
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 3)) for r in langid.query(spark, str(tmp_path)).collect()]
    assert sorted(map(str, (x[:3] for x in got))) == sorted(map(str, (x[:3] for x in want)))
    assert all(abs(g[3] - w[3]) <= 0.002 for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True))


def test_settled_lattices_decode_the_same_in_bounded_memory(monkeypatch):
    import random
    import tracemalloc

    counts = np.zeros(toxicity.SIZE**3, np.int64)
    toxicity.count_trigrams(["the idiot said that these stupid things are not the same as those others " * 5], counts)
    model = toxicity.CharModel(counts)
    r = random.Random(3)
    texts = ["".join(r.choice("abdeiost013457$@!.-*_ é") for _ in range(r.randint(1, 400))) for _ in range(40)] + ["a" * 900 + "1d10t" * 60, "0" * 500, ".-" * 300, "i" * 5 + "1" * 700]
    monkeypatch.setattr(toxicity, "SETTLE", 10**9)
    whole = [model.decode(t) for t in texts]
    for settle in (1, 7, 64):
        monkeypatch.setattr(toxicity, "SETTLE", settle)
        assert [model.decode(t) for t in texts] == whole
    monkeypatch.setattr(toxicity, "SETTLE", 256)
    token = "".join(r.choice("0123456789abcdef") for _ in range(20_000))
    peaks = []
    for n in (5000, 20_000):
        tracemalloc.start()
        model.decode(token[:n])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]
