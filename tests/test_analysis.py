"""The whole plan with small vectors, the gate, decisions and offline stand-ins."""

import pytest
from pyspark.sql import functions as F

from quern.config import DEFAULTS
from quern.functions.tokenlimit import count_tokens, truncate_to_limit
from quern.operators import evaluate as ev
from quern.operators import offline
from quern.operators.filtering import context_filter, llm_decisions
from quern.plans.analysis import analyse, generate

V = "embedding array<float>"


@pytest.fixture(scope="module")
def stores(spark):
    queries = spark.createDataFrame([(1, "+ a", [1.0, 0.0]), (2, "+ b", [0.0, 1.0]), (3, "  ", [1.0, 0.0])], f"query_id long, diff string, {V}")
    reviews = spark.createDataFrame([(10, [1.0, 0.1]), (11, [1.0, 1.0]), (12, [-1.0, 0.2])], f"chunk_id long, {V}")
    repos = spark.createDataFrame([(20, [0.9, 0.0]), (21, [1.0, -1.0])], f"chunk_id long, {V}")
    return queries, reviews, repos


def test_one_plan(stores):
    trace, hits = analyse(*stores)
    got = {r["query_id"]: r for r in trace.collect()}
    assert got[1]["retrieved"] == 5 and got[1]["top_score"] == 1.0 and got[1]["sufficient"] and got[1]["confidence"] > 0.6
    assert [r["chunk_id"] for r in hits.where("query_id = 1").orderBy("rank").collect()][:2] == [20, 10]
    assert (got[3]["retrieved"], got[3]["confidence"], got[3]["needs_confirmation"], got[3]["sufficient"]) == (0, 0.0, True, False)


def test_insufficient_queries_never_reach_the_generator(spark, stores):
    high = DEFAULTS.__class__(sim_threshold=0.99)
    trace, _ = analyse(*stores, settings=high)
    out = generate(trace, lambda df: df.withColumn("draft", F.when(F.col("sufficient"), "text").otherwise(F.raise_error(F.lit("reached")))))
    assert {r["query_id"]: r["draft"] for r in out.collect()} == {1: "text", 2: None, 3: None}


def test_replies_and_fallback(spark):
    hits = spark.createDataFrame([(q, c, s, i) for q in (1, 2) for i, (c, s) in enumerate((("a", 0.9), ("b", 0.8), ("c", 0.1)), 1)], "query_id long, chunk_id string, score double, rank int")
    replies = spark.createDataFrame([(1, '{"decisions": [{"chunk_id": "b", "keep": false}, {"chunk_id": "c"}]}'), (2, "not json")], "query_id long, raw string")
    decisions, modes = llm_decisions(replies)
    assert dict(modes.collect()) == {1: "llm", 2: "llm_fallback"}
    kept = {(r["query_id"], r["chunk_id"]) for r in context_filter(hits, "llm", 0.5, decisions=decisions).where("kept").collect()}
    assert kept == {(1, "a"), (1, "c"), (2, "a"), (2, "b")}


def test_offline_runs(spark):
    corpus = spark.createDataFrame([("k1", ["jwt", "token"]), ("k2", ["retry", "backoff"]), ("k3", [])], "chunk_id string, keywords array<string>")
    cases = spark.createDataFrame([(1, "check JWT token expiry"), (2, "add retry")], "query_id long, query string")
    hits = offline.keyword_topk(cases, corpus, 2)
    assert [tuple(r)[1:3] for r in hits.orderBy("query_id", "rank").collect()] == [("k1", 1.0), ("k2", 0.0), ("k2", 0.5), ("k1", 0.0)]
    filtered = context_filter(hits, "on", 0.5).withColumn("text", F.col("chunk_id"))
    assert dict(offline.simple_confidence(filtered).collect()) == {1: 0.85, 2: 0.5}
    assert dict(offline.template_answer(filtered).collect()) == {1: "k1", 2: "k2"}
    many = corpus.unionByName(spark.range(20_000).select(F.concat(F.lit("z"), "id").alias("chunk_id"), F.array(F.lit("zzz")).alias("keywords")))
    assert hits.select("query_id", "chunk_id", "score").exceptAll(offline.keyword_topk(cases, many, 2).select("query_id", "chunk_id", "score")).count() == 0
    assert dict(ev.reference_free(hits, cases, 0.6).collect()) == {1: False, 2: True}


def test_execution_errors(spark):
    stages = spark.createDataFrame([(1, "Filter"), (2, None)], "query_id long, stage string")
    errors = spark.createDataFrame([(2, "boom"), (3, "bang")], "query_id long, error string")
    assert {r["query_id"]: r["stage"] for r in ev.with_execution_errors(stages, errors).collect()} == {1: "Filter", 2: "Execution", 3: "Execution"}


def test_token_limits(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("a\nb",), (None,)], "t string")
    assert [tuple(r) for r in df.select(count_tokens()("t"), truncate_to_limit(5, 2)("t")).collect()] == [(7, "a b c d e"), (2, "a\nb"), (0, "")]
