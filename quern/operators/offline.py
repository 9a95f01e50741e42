"""Deterministic stand-ins for embedding search, generation and confidence, for runs without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as tx


def _grams(c: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n))))


def keyword_topk(cases: DataFrame, corpus: DataFrame, k: int = DEFAULTS.top_k) -> DataFrame:
    """The k best chunks (chunk_id, keywords) of each case (query_id, query) by the share of keywords its tokens hold.

    A keyword is a substring of the tokens if these hold its first three characters (all of a shorter one) and then the
    whole: grams of one to three characters are the join key, and no case meets a chunk it shares nothing with. Where
    fewer than k chunks share something, the first others by id follow with score 0.
    """
    asked = cases.select("query_id", F.array_join(tx.tokens(F.col("query"), tx.FIXTURE_TOKEN), " ").alias("q"))
    grams = F.flatten(F.array(*(F.when(F.length("q") >= n, _grams(F.col("q"), n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3))))
    words = corpus.select("chunk_id", F.size("keywords").alias("n"), F.posexplode("keywords").alias("pos", "w")).select("chunk_id", "n", "pos", F.lower("w").alias("w"))
    met = asked.select("query_id", "q", F.explode(grams).alias("g")).join(words.where("w <> ''").withColumn("g", F.left("w", F.lit(3))), "g").where(F.contains("q", F.col("w")))
    empty = words.where("w = ''").groupBy("chunk_id").agg(F.count("*").alias("always"))  # an empty keyword is in every text
    hits = met.groupBy("query_id", "chunk_id").agg(F.count("*").alias("hits"))
    first = corpus.select("chunk_id").orderBy("chunk_id").limit(k)  # who follows with score 0
    always = F.broadcast(first).unionByName(empty.select("chunk_id")).distinct()
    pairs = hits.select("query_id", "chunk_id").unionByName(asked.select("query_id").distinct().join(F.broadcast(always), F.lit(True))).distinct()
    sized = corpus.select("chunk_id", F.size("keywords").alias("n"))
    scored = pairs.join(hits, ["query_id", "chunk_id"], "left").join(empty, "chunk_id", "left").join(sized, "chunk_id")
    scored = scored.select("query_id", "chunk_id", F.round(F.coalesce((F.coalesce("hits", F.lit(0)) + F.coalesce("always", F.lit(0))) / F.nullif("n", F.lit(0)), F.lit(0.0)), 4).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def template_answer(kept: DataFrame) -> DataFrame:
    """(query_id, answer) put together from the first three kept hits' texts."""
    got = kept.where("kept").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("_n <= 3")
    return got.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda s: s["text"]), " ").alias("answer"))


def simple_confidence(filtered: DataFrame) -> DataFrame:
    """0.7 of the best kept score and 0.3 of the share that was kept."""
    got = filtered.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("kept"), F.col("score"))), F.lit(0.0)).alias("t"), (F.count_if("kept") / F.count("*")).alias("r"))
    return got.select("query_id", tx.round4(0.7 * F.col("t") + 0.3 * F.col("r")).alias("confidence"))


def failing(column: Column, message: str = "retrieval failed") -> Column:
    """A column that fails wherever it is evaluated, to test that one case's error leaves the others alone."""
    return F.when(column, F.raise_error(F.lit(message)).cast("double"))
