"""Generated answers: failures stay with their case, judged scores, means a run, whole verdicts."""
import pytest
from pyspark.sql import functions as F

from quern.operators import evaluate as ev
from quern.operators import generation as gen

CASE = "run string, query_id long, question string, context string, reference_answer string, reference_keywords array<string>"


def _generator():
    def answer(question, context):
        if "boom" in question:
            raise ValueError("boom")
        if "record" in question:
            return {"answer": "the cache is cleared", "confidence": 0.61239}
        return "" if "silent" in question else context

    return answer


@pytest.fixture(scope="module")
def answered(spark):
    rows = [("on", 1, "how is the cache cleared", "the cache is cleared by a job", "The cache is cleared by a job", None), ("on", 2, "boom", "x", "y", None), ("on", 3, "silent", "x", "y", None), ("on", 4, "record", "nothing of it", "the cache", ["cache"]), ("off", 5, "why", "because of it", None, None)]
    return gen.generate(spark.createDataFrame(rows, CASE), _generator, "test").cache()


def test_one_failure_leaves_the_others(spark, answered):
    got = {r.query_id: (r.answer, r.stated_confidence, r.error) for r in answered.collect()}
    assert got == {1: ("the cache is cleared by a job", None, None), 2: (None, None, "ValueError: boom"), 3: ("", None, None), 4: ("the cache is cleared", 0.6124, None), 5: ("because of it", None, None)}
    again = gen.generate(answered.where("query_id in (1, 2)").drop("answer", "stated_confidence"), _generator, "test")
    assert {r.query_id: r.error for r in again.collect()} == {1: None, 2: "ValueError: boom"}


def test_scores_and_stages(answered):
    got = {r.query_id: r for r in gen.judge_answers(answered, ["run", "query_id"]).collect()}
    assert (got[1].groundedness, got[1].hallucination, got[1].exact_match, got[1].token_f1, got[1].stage) == (1.0, 0.0, 1.0, 1.0, None)
    assert got[2].stage == "Execution" and got[2].groundedness is None and got[2].exact_match is None
    assert got[3].groundedness is None and got[3].exact_match is None and got[3].stage is None
    assert got[4].completeness == 1.0 and got[4].exact_match == 0.0 and got[4].token_f1 == pytest.approx(0.6667)
    assert got[5].exact_match is None and got[5].completeness is None


def test_means_of_a_run(answered):
    got = {r.run: r for r in gen.aggregate_generation(gen.judge_answers(answered, ["run", "query_id"])).collect()}
    assert (got["on"].case_count, got["on"].error_case_count, got["on"].exact_match, got["on"].confidence) == (4, 1, 0.5, 0.6124)
    assert ("Execution", 1) in [tuple(x) for x in got["on"].error_stages]
    assert got["off"].exact_match is None and got["off"].groundedness == 1.0


def verdict(spark, off, on):
    names = sorted({*off, *on})
    df = spark.createDataFrame([("off", *(off.get(n) for n in names)), ("on", *(on.get(n) for n in names))], "run string, " + ", ".join(f"{n} double" for n in names))
    return ev.verdicts(df, "off").first()


def test_whole_verdicts(spark):
    base = {"confidence": 0.6, "post_precision": 0.4, "faithfulness": 0.8, "recall_delta": 0.0, "false_deletion": 0.0, "filter_ratio": 0.0}
    better = verdict(spark, base, base | {"confidence": 0.75, "post_precision": 1.0, "faithfulness": 0.85, "filter_ratio": 0.6})
    assert (better.verdict, better.quality_delta, better.warnings) == ("improved", 0.05, []) and len(better.reasons) == 1
    worse = verdict(spark, base, base | {"confidence": 0.75, "post_precision": 1.0, "faithfulness": 0.7})
    assert (worse.verdict, worse.quality_delta) == ("no_gain", -0.1)
    fake = verdict(spark, base, base | {"confidence": 0.9, "recall_delta": -0.33, "false_deletion": 0.5, "filter_ratio": 0.85})
    assert fake.verdict == "fake_confidence" and len(fake.reasons) == 3 and "-0.33" in fake.reasons[0] and fake.ratio_warning and "0.85" in fake.warnings[0]
    flat = verdict(spark, base, base | {"confidence": 0.5, "filter_ratio": 0.9})
    assert flat.verdict == "no_gain" and flat.reasons == ["confidence did not rise"] and len(flat.warnings) == 1
    thin = verdict(spark, {"confidence": 0.5}, {"confidence": 0.7})
    assert thin.verdict == "improved" and sum("not measured" in r for r in thin.reasons) == 2 and not thin.ratio_warning
    assert verdict(spark, {"groundedness": 0.5, "confidence": 0.1}, {"groundedness": 0.6, "confidence": 0.2}).quality_delta == 0.1
