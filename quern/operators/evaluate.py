"""Evaluation over cases and run configurations: rows per case, aggregates per run, error stages, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as tx
from .confidence import weighted, weights_of
from .metrics import below, mean_metric, share

#: The stages an error can be put down to, in order.
STAGES = ("Retrieval", "Ranking", "Filter", "Context", "Interpretation", "Generation", "Hallucination")


@dataclass(frozen=True)
class Run:
    name: str
    mode: str
    threshold: float
    mean_form: bool = False


def evaluate(hits: DataFrame, gold: DataFrame, runs: list[Run], settings: Settings = DEFAULTS) -> DataFrame:
    """One row a run and query, from one plan over hits that are marked with gold once.

    The runs are rows: each hit is repeated for every run, and all metrics are conditional aggregates of one grouping by
    (run, query), whose window and sums share its shuffle.
    """
    gold = gold.select("query_id", "chunk_id").distinct()
    totals = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    marked = hits.join(gold.withColumn("g", F.lit(True)), ["query_id", "chunk_id"], "left").join(totals, "query_id", "left")
    config = F.explode(F.array(*(F.struct(F.lit(r.name).alias("run"), F.lit(r.mode).alias("mode"), F.lit(float(r.threshold)).alias("threshold"), F.lit(r.mean_form).alias("mean_form")) for r in runs))).alias("r")
    h = marked.select("query_id", "chunk_id", "score", "rank", F.coalesce("g", F.lit(False)).alias("g"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"), config).select("*", "r.*").drop("r")
    k, score, g = settings.eval_k, F.coalesce("score", F.lit(0.0)), F.col("g")
    h = h.withColumn("kept", (F.col("mode") == "off") | (F.col("rank") == 1) | (score >= F.col("threshold")))
    kept, high, top = F.col("kept"), score >= F.col("threshold"), F.col("rank") <= k
    place = Window.partitionBy("run", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("place", F.when(kept, F.sum(F.when(kept, 1).otherwise(0)).over(place)))
    ids = lambda test: F.count_distinct(F.when(test, F.col("chunk_id")))
    n = h.groupBy("run", "query_id").agg(
        F.max("n_gold").alias("n_gold"), F.first("mean_form").alias("mean_form"), F.count("*").alias("n"), F.count_if(kept).alias("n_kept"),
        F.count_if(top).alias("n_top"), F.count_if(top & g).alias("n_hit"), ids(top & g).alias("n_found"), F.min(F.when(g, F.col("rank"))).alias("first_gold"), F.count_if(F.col("score") >= F.col("threshold")).alias("n_above"),
        F.count_if(kept & top).alias("after_top"), F.count_if(kept & top & g).alias("after_hit"), ids(kept & top & g).alias("after_found"),
        ids(g).alias("retrieved_gold"), ids(g & kept).alias("kept_gold"), ids(g & (F.col("place") <= k)).alias("cut_found"),
        F.coalesce(F.max(F.when(kept, score)), F.lit(0.0)).alias("top_score"), F.count_if(kept & high).alias("evidence_count"), F.count_if(kept & (score >= settings.strong_evidence)).alias("strong_count"), F.avg(F.when(kept, F.col("score"))).alias("mean"),
    )
    c, r4 = F.col, lambda x: F.round(x, 4)
    target, ratio = F.lit(float(settings.evidence_target)), r4((c("n") - c("n_kept")) / c("n"))
    parts = {"top": c("top_score"), "evidence": F.least(c("evidence_count") / target, F.lit(1.0)), "strong": F.least(c("strong_count") / target, F.lit(1.0)), "retention": F.greatest(F.lit(0.0), 1 - ratio)}
    plain = F.when(c("n_kept") == 0, 0.0).otherwise(tx.round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted(parts, weights_of(settings))))))
    return n.select(
        "run",
        "query_id",
        r4(share(c("n_hit"), c("n_top"))).alias("precision_at_k"),
        r4(share(c("n_found"), c("n_gold"))).alias("recall_at_k"),
        r4(F.coalesce(1.0 / c("first_gold"), F.lit(0.0))).alias("mrr"),
        F.when(c("n_found") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        (c("n_above") == 0).alias("failed"),
        r4(share(c("after_hit"), c("after_top"))).alias("post_precision"),
        r4(share(c("after_found"), c("n_gold"))).alias("post_recall"),
        ratio.alias("filter_ratio"),
        r4(share(c("retrieved_gold") - c("kept_gold"), c("retrieved_gold"))).alias("false_deletion"),
        r4(share(c("cut_found"), c("n_gold")) - share(c("n_found"), c("n_gold"))).alias("recall_delta"),
        r4(F.when(c("n_gold") == 0, 1.0).otherwise(share(c("kept_gold"), c("n_gold")))).alias("gold_retained"),
        "retrieved_gold",
        "evidence_count",
        c("n_kept").alias("kept_count"),
        F.when(c("mean_form"), tx.round4(F.coalesce("mean", F.lit(0.0)))).otherwise(plain).alias("confidence"),
    )


def aggregate_runs(cases: DataFrame) -> DataFrame:
    """Means over the cases of each run."""
    names = ("precision_at_k", "recall_at_k", "mrr", "hit_rate", "post_precision", "post_recall", "filter_ratio", "false_deletion", "recall_delta", "gold_retained", "confidence")
    return cases.groupBy("run").agg(F.count("*").alias("case_count"), *(mean_metric(F.col(c)).alias(c) for c in names), mean_metric(F.col("failed").cast("double")).alias("failure_rate"))


def verdicts(aggregates: DataFrame, baseline: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Every other run against the baseline: did confidence rise, and did quality with it, with reasons and warnings.

    What was not measured (null, or a column that aggregates lack) speaks neither for nor against a run; a reason says
    so. Quality is faithfulness, else groundedness.
    """
    there = set(aggregates.columns)
    of = lambda row, c: F.col(f"{row}.{c}") if c in there else F.lit(None).cast("double")
    quality = lambda row: F.coalesce(of(row, "faithfulness"), of(row, "groundedness"))
    delta = lambda c: F.round(of("o", c) - of("b", c), 4)
    base = aggregates.where(F.col("run") == baseline)
    joined = aggregates.where(F.col("run") != baseline).alias("o").crossJoin(F.broadcast(base).alias("b"))  # one row each
    got = joined.select(
        F.col("o.run").alias("run"),
        delta("confidence").alias("confidence_delta"),
        delta("post_precision").alias("precision_delta"),
        delta("post_recall").alias("recall_change"),
        F.round(quality("o") - quality("b"), 4).alias("quality_delta"),
        of("o", "recall_delta").alias("recall_delta"),
        of("o", "false_deletion").alias("false_deletion"),
        of("o", "filter_ratio").alias("filter_ratio"),
    )
    at_least = lambda c: F.coalesce(F.col(c) >= 0, F.lit(True))
    less, deleted = F.coalesce(F.col("recall_delta") < 0, F.lit(False)), F.coalesce(F.col("false_deletion") > 0, F.lit(False))
    up, harm = F.coalesce(F.col("confidence_delta") > 0, F.lit(False)), less | deleted
    verdict = F.when(up & harm, "fake_confidence").when(up & at_least("precision_delta") & at_least("quality_delta"), "improved").otherwise("no_gain")
    is_ = lambda v: F.col("verdict") == v
    number = lambda c: F.col(c).cast("string")
    reasons = [
        F.when(less, F.concat(F.lit("recall fell by the filter: "), number("recall_delta"))),
        F.when(deleted, F.concat(F.lit("the filter removed gold chunks: "), number("false_deletion"))),
        F.when(is_("fake_confidence"), "confidence rose while information was lost; lower the threshold"),
        F.when(is_("improved"), "confidence rose and no information was lost"),
        F.when(is_("improved") & F.col("precision_delta").isNull(), "precision was not measured"),
        F.when(is_("improved") & F.col("quality_delta").isNull(), "answer quality was not measured"),
        F.when(is_("no_gain") & ~up, "confidence did not rise"),
        F.when(is_("no_gain") & harm, "information was lost"),
    ]
    high = F.coalesce(F.col("filter_ratio") > settings.filter_ratio_warn, F.lit(False))
    warning = F.when(high, F.concat(F.lit("check retrieval: filter ratio "), number("filter_ratio"), F.lit(f" > {settings.filter_ratio_warn}")))
    said = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull())
    return got.withColumn("verdict", verdict).withColumns({"ratio_warning": high, "reasons": said(reasons), "warnings": said([warning])})


def error_stage(has_gold: Column, gold_retrieved: Column, gold_in_top_k: Column, gold_kept: Column, scores: dict[str, Column], answer: Column, judged: Column, settings: Settings = DEFAULTS) -> Column:
    """The first stage that explains a case's failure; null if none does. scores may lack criteria; judged: some score was asked for."""
    t, nothing = settings.score_pass, F.lit(None).cast("double")
    s = lambda name: scores.get(name, nothing)
    return (
        F.when(has_gold & ~gold_retrieved, STAGES[0])
        .when(has_gold & ~gold_in_top_k, STAGES[1])
        .when(has_gold & ~gold_kept, STAGES[2])
        .when(below(s("context_relevance"), t), STAGES[3])
        .when(below(s("answer_relevance"), t) | below(s("completeness"), t), STAGES[4])
        .when((tx.strip(F.coalesce(answer, F.lit(""))) == "") & judged, STAGES[5])
        .when((tx.strip(F.coalesce(answer, F.lit(""))) != "") & (F.coalesce(s("hallucination") > settings.hallucination_limit, F.lit(False)) | below(s("groundedness"), t) | below(s("faithfulness"), t)), STAGES[6])
    )


def stage_histogram(stages: DataFrame) -> DataFrame:
    """Cases per stage, most first, names break ties."""
    return stages.where("stage is not null").groupBy("stage").agg(F.count("*").alias("cases")).orderBy(F.desc("cases"), "stage")


def silver_gold(hits: DataFrame, threshold: float = DEFAULTS.silver_threshold, most: int = DEFAULTS.silver_max_gold) -> DataFrame:
    """The first hits that reach the threshold, at most so many; the best hit where none does."""
    ok = F.col("score") >= threshold
    return hits.where((ok & (F.col("rank") <= most)) | ((F.col("rank") == 1) & ~ok))


def reference_free(hits: DataFrame, queries: DataFrame, threshold: float = DEFAULTS.sim_threshold) -> DataFrame:
    """Without gold only the failure flag is known: (query_id, failed)."""
    got = hits.groupBy("query_id").agg(F.count_if(F.col("score") >= threshold).alias("n"))
    return queries.select("query_id").join(got, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) == 0).alias("failed"))


def with_execution_errors(stages: DataFrame, errors: DataFrame) -> DataFrame:
    """Cases that failed to run get the stage Execution; the others keep theirs."""
    got = stages.join(errors.select("query_id", "error").dropDuplicates(["query_id"]), "query_id", "full_outer")
    return got.select("query_id", F.when(F.col("error").isNotNull(), "Execution").otherwise(F.col("stage")).alias("stage"), "error")
