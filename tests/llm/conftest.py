import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, fp long, label long, bucket int, rank int"


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in ("ba", "co", "du", "fi", "ga", "ho", "ki", "lu") for b in ("nter", "mle", "rst", "vin", "zo", "pal", "sked", "")]


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, copies."""
    base = sentence(1, 60)
    long = sentence(2, 30_000)
    rows = [(1, base), (2, None), (3, ""), (4, " \t\n"), (5, base), (5, base), (6, base.upper()), (None, base), (7, long), (8, "a"), (9, "日本語 テキスト \U0001f600 " + base), (10, "é" * 300), (None, None), (11, base + " tail"), (12, "x" * 5000)]
    return [(d, t, None if k % 3 else "en", None, k, 0.5, "clash", 7, 1, 3, 9) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, tiny):
    return spark.read.parquet(f"{tiny}/labels.parquet")
