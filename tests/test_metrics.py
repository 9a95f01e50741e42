"""Hand-calculated values of retrieval, filter and confidence metrics."""

import pytest
from pyspark.sql import functions as F

from quern.config import DEFAULTS, Settings, filter_mode
from quern.operators import evaluate as ev
from quern.operators.confidence import confidence, weighted
from quern.operators.filtering import context_filter, filter_outcome
from quern.operators.metrics import below, filter_metrics, hallucination_flag, retrieval_metrics
from quern.operators.retrieval import merge_sources, sufficiency

GOLD = ["c2", "c4"]
HITS = "query_id long, chunk_id string, score double, rank int"


def hits(spark, scores, names=None):
    names = names or [f"c{i + 1}" for i in range(len(scores))]
    return spark.createDataFrame([(1, n, float(s), i + 1) for i, (n, s) in enumerate(zip(names, scores, strict=True))], HITS)


def gold(spark, names=GOLD):
    return spark.createDataFrame([(1, n) for n in names], "query_id long, chunk_id string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


@pytest.mark.parametrize(("k", "precision", "recall", "hit"), [(5, 0.4, 1.0, 1.0), (3, 0.3333, 0.5, 1.0), (1, 0.0, 0.0, 0.0)])
def test_retrieval_metrics(spark, k, precision, recall, hit):
    got = one(retrieval_metrics(hits(spark, [0.9, 0.8, 0.7, 0.6, 0.5]), gold(spark), k))
    assert (got["precision_at_k"], got["recall_at_k"], got["hit_rate"], got["mrr"]) == (precision, recall, hit, 0.5)


def test_repeated_ids_count_in_precision_only(spark):
    got = one(retrieval_metrics(hits(spark, [0.9, 0.8, 0.7], ["c2", "c2", "c1"]), gold(spark), 3))
    assert (got["precision_at_k"], got["recall_at_k"]) == (0.6667, 0.5)


def test_nothing_retrieved_is_a_failure(spark):
    got = one(retrieval_metrics(hits(spark, [], []), gold(spark), 5))
    assert got["failed"] and got["precision_at_k"] == got["recall_at_k"] == got["mrr"] == 0.0


def test_filter_metrics(spark):
    kept = F.col("chunk_id").isin("c1", "c2")
    got = one(filter_metrics(hits(spark, [0.9, 0.8, 0.7, 0.6, 0.5]).withColumn("kept", kept), gold(spark), 5))
    assert got == {"query_id": 1, "filter_ratio": 0.6, "gold_retained": 0.5, "false_deletion": 0.5, "recall_delta": -0.5, "deleted_gold": 1, "retrieved_gold": 2}


def test_gold_never_retrieved_is_no_false_deletion(spark):
    got = one(filter_metrics(hits(spark, [0.9], ["x"]).withColumn("kept", F.lit(True)), gold(spark), 5))
    assert got["false_deletion"] == 0.0


def test_confidence_by_hand(spark):
    s = Settings(strong_evidence=0.75)
    got = one(confidence(context_filter(hits(spark, [0.9, 0.8, 0.6]), "on", 0.5), s))
    assert got["confidence"] == round(0.5 * 0.9 + 0.2 + 0.2 * 2 / 3 + 0.1, 4)


def test_best_hit_stays_but_is_no_evidence(spark):
    got = one(confidence(context_filter(hits(spark, [0.3, 0.2]), "on", 0.5), DEFAULTS))
    assert (got["kept_count"], got["evidence_count"], got["needs_confirmation"]) == (1, 0, True)


def test_weak_padding_changes_nothing(spark):
    full = one(confidence(context_filter(hits(spark, [0.9, 0.8]), "off"), DEFAULTS))
    padded = one(confidence(context_filter(hits(spark, [0.9, 0.8, 0.1, 0.05]), "off"), DEFAULTS))
    assert full["confidence"] == padded["confidence"] and (padded["evidence_count"], padded["kept_count"]) == (2, 4)


def test_weights_are_normalised(spark):
    parts = {k: F.lit(1.0) for k in ("top", "evidence", "strong", "retention")}
    assert spark.range(1).select(weighted(parts, {"top": 5, "evidence": 2, "strong": 2, "retention": 1})).first()[0] == 1.0
    assert spark.range(1).select(weighted(parts, {"top": 0})).first()[0] == 0.0


def test_information_loss(spark):
    weak = one(filter_outcome(context_filter(hits(spark, [0.9, 0.8, 0.3, 0.2]), "on", 0.5), 0.5))
    assert (weak["filter_ratio"], weak["information_loss"]) == (0.5, 0.0)
    strong = one(filter_outcome(context_filter(hits(spark, [0.9, 0.8]), "on", relevance=F.lit(False)), 0.5))
    assert (strong["information_loss"], strong["top1_preserved"]) == (0.5, True)


def test_decisions_fall_back_to_the_threshold(spark):
    decisions = spark.createDataFrame([(1, "c2", False)], "query_id long, chunk_id string, keep boolean")
    got = context_filter(hits(spark, [0.9, 0.8, 0.7, 0.1]), "llm", 0.5, decisions=decisions)
    assert {r["chunk_id"]: r["kept"] for r in got.collect()} == {"c1": True, "c2": False, "c3": True, "c4": False}


def test_merge_puts_the_better_score_first_and_reviews_on_ties(spark):
    a, b = hits(spark, [0.6, 0.5], ["cr-1", "cr-2"]), hits(spark, [0.8, 0.6], ["repo-1", "repo-2"])
    merged = merge_sources(a, b)
    assert [r["chunk_id"] for r in merged.orderBy("merged_rank").collect()] == ["repo-1", "cr-1", "repo-2", "cr-2"]
    assert one(sufficiency(merged, 0.5))["sufficient"]


def test_hallucination_prefers_its_own_score(spark):
    rows = spark.createDataFrame([(0.9, 0.9), (0.1, 0.1), (None, 0.2), (None, 0.9), (None, None)], "h double, g double")
    assert [r[0] for r in rows.select(hallucination_flag(F.col("h"), F.col("g"), F.lit(None).cast("double"))).collect()] == [True, False, True, False, None]


def test_unknown_is_not_below(spark):
    assert spark.createDataFrame([(None,), (0.5,), (0.6,)], "s double").select(below(F.col("s"), 0.6)).collect() == [(False,), (True,), (False,)]


VERDICTS = [((0.1, 0.1, 0.0, 0.0, 0.3), "improved", False), ((0.1, 0.1, -0.1, 0.0, 0.3), "fake_confidence", False), ((0.1, 0.1, 0.0, 0.2, 0.3), "fake_confidence", False), ((-0.1, 0.1, 0.0, 0.0, 0.9), "no_gain", True), ((0.1, -0.1, 0.0, 0.0, 0.8), "no_gain", False)]


@pytest.mark.parametrize(("deltas", "verdict", "warns"), VERDICTS)
def test_verdicts(spark, deltas, verdict, warns):
    conf, prec, recall, deleted, ratio = deltas
    rows = [("off", 0.5, 0.5, 0.5, 0.0, 0.0, 0.0), ("on", 0.5 + conf, 0.5 + prec, 0.5, recall, deleted, ratio)]
    agg = spark.createDataFrame(rows, "run string, confidence double, post_precision double, post_recall double, recall_delta double, false_deletion double, filter_ratio double")
    got = one(ev.verdicts(agg, "off"))
    assert (got["verdict"], got["ratio_warning"]) == (verdict, warns)


@pytest.mark.parametrize(("raw", "mode"), [("OFF", "off"), (" none ", "off"), ("0", "off"), ("LLM", "llm"), ("", "on"), (None, "on"), ("yes", "on")])
def test_filter_mode(raw, mode):
    assert filter_mode(raw) == mode
