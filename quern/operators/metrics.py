"""Retrieval, filter and signal metrics, one row a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as tx


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def retrieval_metrics(hits: DataFrame, gold: DataFrame, k: int = DEFAULTS.eval_k, threshold: float = DEFAULTS.sim_threshold, kept: Column | None = None) -> DataFrame:
    """Precision, recall, reciprocal rank, hit and failure.

    hits: query_id, chunk_id, score, rank; gold: query_id, chunk_id. Precision counts repeated ids, recall does not.
    With kept, only those hits count, in their order. Reciprocal rank looks at all ranks.
    """
    hits = hits if kept is None else hits.where(kept)
    marked = hits.join(gold.select("query_id", "chunk_id").distinct().withColumn("is_gold", F.lit(True)), ["query_id", "chunk_id"], "left")
    totals = gold.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    is_gold, top = F.coalesce("is_gold", F.lit(False)), F.col("rank") <= k
    got = marked.groupBy("query_id").agg(
        F.count_if(top).alias("n_top"),
        F.count_if(top & is_gold).alias("n_hit"),
        F.count_distinct(F.when(top & is_gold, F.col("chunk_id"))).alias("n_found"),
        F.min(F.when(is_gold, F.col("rank"))).alias("first_gold"),
        F.count_if(F.col("score") >= threshold).alias("n_above"),
    )
    got = got.join(totals, "query_id", "full_outer")
    n = lambda c: F.coalesce(c, F.lit(0))
    return got.select(
        "query_id",
        F.round(share(n("n_hit"), n("n_top")), 4).alias("precision_at_k"),
        F.round(share(n("n_found"), n("n_gold")), 4).alias("recall_at_k"),
        F.round(F.coalesce(1.0 / F.col("first_gold"), F.lit(0.0)), 4).alias("mrr"),
        F.when(n("n_found") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        (n("n_above") == 0).alias("failed"),
    )


def filter_metrics(filtered: DataFrame, gold: DataFrame, k: int = DEFAULTS.eval_k) -> DataFrame:
    """Filter ratio, gold retained, false deletion, change of recall, and the counts behind them."""
    marked = filtered.join(gold.select("query_id", "chunk_id").distinct().withColumn("is_gold", F.lit(True)), ["query_id", "chunk_id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    totals = gold.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    kept, is_gold = F.col("kept"), F.col("is_gold")
    ids = lambda test: F.count_distinct(F.when(test, F.col("chunk_id")))
    # A kept hit's place among the kept ones is what the cut at k sees.
    place = F.sum(F.when(kept, 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    got = marked.withColumn("kept_rank", F.when(kept, place)).groupBy("query_id").agg(
        F.count("*").alias("n_retrieved"),
        F.count_if(~kept).alias("n_removed"),
        ids(is_gold).alias("retrieved_gold"),
        ids(is_gold & kept).alias("kept_gold"),
        ids(is_gold & (F.col("rank") <= k)).alias("before"),
        ids(is_gold & (F.col("kept_rank") <= k)).alias("after"),
    )
    got = got.join(totals, "query_id", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    return got.select(
        "query_id",
        F.round(F.col("n_removed") / F.col("n_retrieved"), 4).alias("filter_ratio"),
        F.round(F.when(F.col("n_gold") == 0, 1.0).otherwise(share(F.col("kept_gold"), F.col("n_gold"))), 4).alias("gold_retained"),
        F.round(share(F.col("retrieved_gold") - F.col("kept_gold"), F.col("retrieved_gold")), 4).alias("false_deletion"),
        F.round(share(F.col("after"), F.col("n_gold")) - share(F.col("before"), F.col("n_gold")), 4).alias("recall_delta"),
        (F.col("retrieved_gold") - F.col("kept_gold")).alias("deleted_gold"),
        "retrieved_gold",
    )


def retrieval_signals(filtered: DataFrame, strong: float = DEFAULTS.strong_evidence) -> DataFrame:
    """Max, mean, count and strong count of the kept scores; all kept hits are evidence here."""
    return filtered.where("kept").groupBy("query_id").agg(F.max("score").alias("top_score"), tx.round4(F.avg("score")).alias("mean_score"), F.count("*").alias("evidence_count"), F.count_if(F.col("score") >= strong).alias("strong_count"))


def mean_metric(c: Column) -> Column:
    """The mean of what is known, to four places; 0 if nothing is."""
    return tx.round4(F.coalesce(F.avg(c), F.lit(0.0)))


def hallucination_flag(hallucination: Column, groundedness: Column, faithfulness: Column, limit: float = DEFAULTS.score_pass) -> Column:
    """Whether a case counts as hallucinated; null if no score is known."""
    return F.when(hallucination.isNotNull(), hallucination >= limit).when(F.coalesce(groundedness, faithfulness).isNotNull(), F.coalesce(groundedness, faithfulness) < limit)


def below(score: Column, threshold: float) -> Column:
    """An unknown score is not below."""
    return F.coalesce(score < threshold, F.lit(False))


def token_f1(pairs: DataFrame, key: list[str], answer: str, reference: str) -> DataFrame:
    """(key, f1): the harmonic mean of token precision and recall, each token as often as in both; 0 if either has none.

    Rows are dealt by their key once, and both counts, a token's and a row's, are made there, so the work grows with the tokens.
    """
    side = lambda c, mine, theirs: F.transform(tx.tokens(F.col(c)), lambda t: F.struct(t.alias("t"), F.lit(mine).alias("a"), F.lit(theirs).alias("r")))
    one = pairs.select(*key, F.explode_outer(F.concat(side(answer, 1, 0), side(reference, 0, 1))).alias("x")).repartition(*key)
    counted = one.groupBy(*key, F.col("x.t").alias("t")).agg(F.sum("x.a").alias("a"), F.sum("x.r").alias("r"))
    got = counted.groupBy(*key).agg(F.sum(F.least("a", "r")).alias("both"), F.sum("a").alias("a"), F.sum("r").alias("r"))
    return got.select(*key, F.coalesce(tx.round4(2.0 * F.col("both") / F.nullif(F.when((F.col("a") > 0) & (F.col("r") > 0), F.col("a") + F.col("r")), F.lit(0))), F.lit(0.0)).alias("f1"))


def aggregate_signals(signals: DataFrame, names: list[str]) -> DataFrame:
    """One row: the mean of what is known of each signal, 0 where nothing is."""
    return signals.agg(*(mean_metric(F.col(c).cast("double")).alias(c) for c in names))
