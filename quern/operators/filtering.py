"""Context filter: the best hit always stays, the others by threshold or by decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS


def relevant(threshold: float = DEFAULTS.sim_threshold) -> Column:
    return F.coalesce("score", F.lit(0.0)) >= threshold


def context_filter(hits: DataFrame, mode: str = "on", threshold: float = DEFAULTS.sim_threshold, relevance: Column | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """hits (query_id, chunk_id, score, rank) with a column kept.

    off keeps all. on keeps rank 1 and what is relevant (a given Column or the threshold). llm takes decisions
    (query_id, chunk_id, keep); a hit without one falls back to the threshold, and so do all without decisions.
    """
    if mode == "off":
        return hits.withColumn("kept", F.lit(True))
    test = relevant(threshold) if relevance is None else relevance
    if mode == "llm" and decisions is not None:
        hits = hits.join(decisions.select("query_id", "chunk_id", "keep"), ["query_id", "chunk_id"], "left")
        return hits.withColumn("kept", (F.col("rank") == 1) | F.coalesce("keep", test)).drop("keep")
    return hits.withColumn("kept", (F.col("rank") == 1) | F.coalesce(test, F.lit(False)))


def filter_outcome(filtered: DataFrame, threshold: float = DEFAULTS.sim_threshold) -> DataFrame:
    """One row a query: counts, filter ratio, information loss, whether the best hit stayed."""
    kept, high = F.col("kept"), relevant(threshold)
    return filtered.groupBy("query_id").agg(
        F.count("*").alias("retrieved"),
        F.count_if(kept).alias("n_kept"),
        F.round(F.count_if(~kept) / F.count("*"), 4).alias("filter_ratio"),
        F.round(F.coalesce(F.count_if(~kept & high) / F.nullif(F.count_if(high), F.lit(0)), F.lit(0.0)), 4).alias("information_loss"),
        F.bool_or(kept & (F.col("rank") == 1)).alias("top1_preserved"),
    )


REPLY = "decisions array<struct<chunk_id:string,keep:boolean>>"


def llm_decisions(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From a model's replies (query_id, raw): (decisions for context_filter, mode of each query).

    A decision without keep keeps. A reply that is missing or holds no list gives no decisions, so the threshold
    decides, and its mode is llm_fallback.
    """
    read = replies.select("query_id", F.from_json("raw", REPLY)["decisions"].alias("d"))
    made = read.select("query_id", F.explode("d").alias("x")).select("query_id", "x.chunk_id", F.coalesce("x.keep", F.lit(True)).alias("keep"))
    return made.dropDuplicates(["query_id", "chunk_id"]), read.select("query_id", F.when(F.col("d").isNull(), "llm_fallback").otherwise("llm").alias("mode"))
