"""Offline judges: column expressions that stand in for a model; injected model columns may be given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Keywords that are never important by themselves.
STOP_PHRASES = ("수정함", "업데이트", "테스트 완료", "코드 정리", "버그 수정", "리팩토링")
#: Fixed value: made-up names.
MOCK_ID = r"(?i)^(record-[0-9]+|test-.*|mock_.*|dummy@.*|foo|bar)$"
#: Techniques named without more.
BARE_TECH = ("python", "javascript", "typescript", "react", "fastapi", "github", "java")
#: The criteria of which an important keyword needs one; and what answers are judged by.
IMPORTANT_CRITERIA = ("A", "B", "C", "D")
CRITERIA = ("groundedness", "faithfulness", "hallucination", "context_relevance", "completeness", "answer_relevance")


def reference_keywords(keywords: Column, answer: Column) -> Column:
    """A reference's keywords: its list, else the tokens of its answer; none without either."""
    return F.when(F.size(keywords) > 0, keywords).otherwise(tx.content_tokens(answer))


def generation_judge(question: Column, context: Column, answer: Column, reference: Column, answer_tokens: Column | None = None, question_tokens: Column | None = None) -> dict[str, Column]:
    """The offline scores; null where a criterion has nothing to compare with.

    Without tokens of its own an answer or a question is covered to 0. Tokens may be given, so that a plan makes them once.
    """
    mine = tx.content_tokens(answer) if answer_tokens is None else answer_tokens
    asked = tx.content_tokens(question) if question_tokens is None else question_tokens
    grounded = tx.coverage(mine, F.concat(F.coalesce(context, F.lit("")), F.lit("\n"), F.coalesce(question, F.lit(""))))
    given = F.coalesce(F.size(reference), F.lit(0)) > 0
    needles = F.when(given, reference).otherwise(asked)
    r4 = tx.round4
    return {
        "groundedness": r4(grounded),
        "faithfulness": r4(grounded),
        "hallucination": r4(1 - grounded),
        "context_relevance": r4(tx.coverage(asked, context)),
        "completeness": F.when(given, r4(tx.coverage(reference, answer))),
        "answer_relevance": F.when(F.size(needles) > 0, r4(tx.coverage(needles, answer))),
    }


def model_scores(replies: DataFrame) -> DataFrame:
    """A model's judgements from (query_id, criterion, raw, error): (query_id, criterion, score, reason, error, source).

    A failed call, a reply that is no JSON object and a score that is no number give no score and an error, so that
    means leave them out. A missing score is unknown, not an error.
    """
    score = F.get_json_object("raw", "$.score")
    is_record = F.try_parse_json("raw").isNotNull() & F.col("raw").rlike(r"^\s*\{")
    value = F.when(score.rlike(tx.NUMBER), score.try_cast("double"))
    error = (
        F.when(~F.col("criterion").isin(*CRITERIA), "unsupported_criterion")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.coalesce(is_record, F.lit(False)), "invalid_reply")
        .when(score.isNotNull() & value.isNull(), "invalid_score")
    )
    return replies.select("query_id", "criterion", error.alias("error"), value.alias("v"), F.coalesce(F.get_json_object("raw", "$.reason"), F.lit("")).alias("r")).select(
        "query_id", "criterion", F.when(F.col("error").isNull(), F.col("v")).alias("score"), F.when(F.col("error").isNull(), F.col("r")).otherwise(F.col("error")).alias("reason"), "error", F.lit("llm").alias("source")
    )


def offline_keyword_label(keyword: Column) -> Column:
    """not_important where a pattern alone settles it, else null; never important."""
    n = tx.normalized(F.coalesce(keyword, F.lit("")))
    return F.when((n == "") | n.isin(*STOP_PHRASES) | n.rlike(MOCK_ID) | n.isin(*BARE_TECH), "not_important")


def keyword_label(keyword: Column, model_label: Column, criteria: Column, failed: Column) -> Column:
    """Offline first, then the model's label; important needs one of the criteria A to D; a failure is not_important."""
    guarded = F.when(F.coalesce(failed, F.lit(False)), "not_important").when((model_label == "important") & ~F.coalesce(F.exists(criteria, lambda c: c.isin(*IMPORTANT_CRITERIA)), F.lit(False)), "not_important").otherwise(model_label)
    return F.coalesce(offline_keyword_label(keyword), guarded, F.lit("not_important"))


def keyword_totals(judged: DataFrame, prs: DataFrame | None = None) -> DataFrame:
    """One row over judged keywords (pr_id, label, background, error): counts, and rates among those that were judged at all.

    prs (pr_id) are all pull requests that were judged, so that one without keywords counts too; without it those with keywords are counted.
    """
    ok = F.col("error").isNull()
    got = judged.agg(
        F.count_distinct("pr_id").alias("pr_count"),
        F.count("*").alias("total_keywords"),
        F.count_if(~ok).alias("error_count"),
        F.count_if(ok & (F.col("label") == "important")).alias("i"),
        F.count_if(ok & F.coalesce("background", F.lit(False))).alias("b"),
    )
    rate = lambda c: F.coalesce(F.round(F.col(c) / F.nullif(F.col("total_keywords") - F.col("error_count"), F.lit(0)), 3), F.lit(0.0))
    if prs is not None:
        got = got.drop("pr_count").join(F.broadcast(prs.agg(F.count_distinct("pr_id").alias("pr_count"))), how="cross")  # a row each
    return got.select("pr_count", "total_keywords", "error_count", rate("i").alias("important_rate"), rate("b").alias("background_inference_rate"))


def frontend_fragment(judged: DataFrame) -> DataFrame:
    """One row a PR from its judged keywords (pr_id, idx, keyword, label, criteria, reason, background, roles): tags, impacts, follow-ups and checks of the important ones, in order.

    A PR's keywords are few (the extraction has a limit), so they are gathered a PR.
    """
    row = F.struct("idx", "keyword", "criteria", "reason", "background", "roles")
    got = judged.where("label = 'important'").groupBy("pr_id").agg(F.array_sort(F.collect_list(row)).alias("ks"))
    got = judged.select("pr_id").distinct().join(got, "pr_id", "left").withColumn("ks", F.coalesce("ks", F.array()))
    word = lambda k: F.coalesce(k["keyword"], F.lit(""))
    short = F.filter("ks", lambda k: (word(k) != "") & (F.length(word(k)) - F.length(F.replace(word(k), F.lit(" "))) <= 3))
    impacts = F.flatten(F.transform("ks", lambda k: F.transform(F.coalesce(k["roles"], F.array().cast("array<string>")), lambda r: F.struct(r.alias("role"), k["reason"].alias("description"), F.lit("info").alias("variant")))))
    todo = F.filter("ks", lambda k: F.array_contains(k["criteria"], "B"))
    return got.select(
        "pr_id",
        F.transform(short, word).alias("feature_tags"),
        impacts.alias("impacts"),
        F.transform(todo, lambda k: F.struct(F.concat(F.lit("kw-"), k["idx"].cast("string")).alias("id"), k["keyword"].alias("label"), F.lit(False).alias("completed"))).alias("follow_ups"),
        F.transform(F.filter("ks", lambda k: F.coalesce(k["background"], F.lit(False))), lambda k: k["reason"]).alias("checks"),
    )
