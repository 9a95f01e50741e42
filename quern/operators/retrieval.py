"""Retrieval: top-k per source, merge, sufficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as tx
from ..functions.vector import best_candidates


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = DEFAULTS.top_k, keys: tuple[str, ...] = (), skip_self: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest rows by cosine rounded to four places, ties by id.

    With skip_self a query does not find the row of its own id.
    """
    found = best_candidates(corpus, queries, k, keys, skip_self).select("query_id", "chunk_id", F.round("similarity", 4).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalize_review(rows: DataFrame, table_name: str = "code_review_vectors") -> DataFrame:
    """Rows of the review store in the common chunk form."""
    c = F.col
    return rows.select(
        "query_id",
        F.concat(F.lit("cr-"), c("id").cast("string")).alias("chunk_id"),
        F.lit("review").alias("source_type"),
        F.coalesce(F.nullif("dataset_source", F.lit("")), F.lit(table_name)).alias("source"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"),
        tx.truthy(c("review_comment"), c("pr_diff"), c("source_code")).alias("text"),
        "orig_idx",
        "has_issue",
        c("id").cast("string").alias("id"),
        "dataset_source",
        "source_code",
        "pr_diff",
        "review_comment",
        F.lit(None).cast("string").alias("file_path"),
    )


def normalize_repo(rows: DataFrame) -> DataFrame:
    """Rows of the project code store in the common chunk form."""
    return rows.select(
        "query_id",
        F.concat(F.lit("repo-"), F.left("node_id", F.lit(8))).alias("chunk_id"),
        F.lit("repo").alias("source_type"),
        F.col("metadata.file_path").alias("source"),
        F.round("score", 4).alias("score"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def merge_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sources' hits, best first; on a tie the first source's come first, in their own order."""
    both = first.withColumn("src_ord", F.lit(0)).unionByName(second.withColumn("src_ord", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "src_ord", "rank")
    return both.withColumn("merged_rank", F.row_number().over(order))


def sufficiency(hits: DataFrame, threshold: float = DEFAULTS.sim_threshold, least: int = DEFAULTS.min_evidence) -> DataFrame:
    """One row a query: the best score, how many reach the threshold, whether that is enough, and why."""
    got = hits.groupBy("query_id").agg(F.count("*").alias("retrieved"), F.max("score").alias("top_score"), F.count_if(F.col("score") >= threshold).alias("above_threshold"))
    enough = F.col("above_threshold") >= least
    return got.withColumns({"sufficient": enough, "reason": F.when(F.col("retrieved") == 0, "no results").when(enough, "ok").otherwise("insufficient grounding")})


def retrieve_with_signals(queries: DataFrame, reviews: DataFrame, repos: DataFrame | None, settings: Settings = DEFAULTS, skip_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged hits of both stores, sufficiency of each query); the repo store is asked only where there is one."""
    hits = vector_topk(queries, reviews, settings.top_k, skip_self=skip_self)
    merged = merge_sources(hits, vector_topk(queries, repos, settings.top_k, skip_self=skip_self)) if repos is not None else hits.withColumns({"src_ord": F.lit(0), "merged_rank": F.col("rank")})
    return merged, sufficiency(merged, settings.sim_threshold, settings.min_evidence)
