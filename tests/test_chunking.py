"""Chunks at text boundaries: nothing lost, nothing over budget, boundaries as strong as can be."""
import random

import pytest

from quern.operators.chunking import chunk_text, chunks, words


def chars(text):
    return len(text)


def sample(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé日") for _ in range(r.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(1, 14))) + r.choice(".!?") + r.choice([" ", "\n"])
    return "".join("".join(sentence() for _ in range(r.randint(1, 6))) + r.choice(["\n\n", "\n \n", ""]) for _ in range(r.randint(0, 8)))


@pytest.mark.parametrize("size, overlap, count", [(12, 3, words), (5, 0, words), (1, 0, words), (40, 10, chars), (7, 6, chars), (1, 0, chars)])
def test_nothing_lost_and_nothing_over_budget(size, overlap, count):
    for seed in range(40):
        text = sample(seed)
        got = chunks(text, size, overlap, count)
        if not text:
            assert got == []
            continue
        assert got[0][0] == 0 and got[-1][1] == len(text)
        for (a, b), (c, d) in zip(got, got[1:]):
            assert a < c <= b < d and count(text[c:b]) <= overlap
        assert all(count(text[a:b]) <= size for a, b in got)
        # Without overlap a chunk could not have taken the next unit too.
        if overlap == 0 and count is words and size > 1:
            assert all(words(text[a:b]) + words(text[b:d]) > size or words(text[b:d]) == 0 for (a, b), (_, d) in zip(got, got[1:]))


def test_strong_boundaries_first():
    text = "One two three. Four five.\n\nSix seven eight nine. Ten."
    cut = lambda n, o=0: [text[a:b] for a, b in chunks(text, n, o)]
    assert cut(20) == [text]
    assert cut(5) == ["One two three. Four five.\n\n", "Six seven eight nine. Ten."]
    assert cut(4) == ["One two three. ", "Four five.\n\n", "Six seven eight nine. ", "Ten."]
    assert cut(3) == ["One two three. ", "Four five.\n\nSix ", "seven eight nine. ", "Ten."]
    assert [text[a:b] for a, b in chunks("a b. c d. e f.", 4, 2)] and [t for t in ("a b. c d. ", "c d. e f.")] == ["a b. c d. e f."[a:b] for a, b in chunks("a b. c d. e f.", 4, 2)]
    with pytest.raises(ValueError):
        chunks("a", 3, 3)


def test_long_words_and_texts():
    assert [b - a for a, b in chunks("x" * 100, 30, 0, chars)] == [25, 25, 25, 25]
    got = chunks("word " * 50_000, 512, 50)
    assert got[-1][1] == 250_000 and all(b - a <= 512 * 5 for a, b in got)


def test_table(spark):
    df = spark.createDataFrame([(1, "a b. c d. e f.", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, tag string")
    got = sorted(tuple(r) for r in chunk_text(df, size=4, overlap=2).collect())
    assert got == [(1, "x", 0, 0, 10, "a b. c d. "), (1, "x", 1, 5, 14, "c d. e f.")]
    assert chunk_text(df.select("text"), size=4, overlap=0).count() == 2
