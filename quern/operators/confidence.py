"""Confidence of a query's kept hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import round4


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted mean; 0 if the weights sum to nothing."""
    total = sum(weights.values())
    if total <= 0:
        return F.lit(0.0)
    return sum((F.lit(weights[k]) * parts[k] for k in weights), F.lit(0.0)) / total


def weights_of(settings: Settings) -> dict[str, float]:
    return {"top": settings.weight_top, "evidence": settings.weight_evidence, "strong": settings.weight_strong, "retention": settings.weight_retention}


def confidence(filtered: DataFrame, settings: Settings = DEFAULTS, use_information_loss: bool = True) -> DataFrame:
    """One row a query over hits with kept; retention takes the information loss, or (in evaluation) the filter ratio."""
    kept, score, high = F.col("kept"), F.coalesce("score", F.lit(0.0)), F.coalesce("score", F.lit(0.0)) >= settings.sim_threshold
    got = filtered.groupBy("query_id").agg(
        F.coalesce(F.max(F.when(kept, score)), F.lit(0.0)).alias("top_score"),
        F.count_if(kept).alias("kept_count"),
        F.count_if(kept & high).alias("evidence_count"),
        F.count_if(kept & (score >= settings.strong_evidence)).alias("strong_count"),
        F.round(F.count_if(~kept) / F.count("*"), 4).alias("filter_ratio"),
        F.round(F.coalesce(F.count_if(~kept & high) / F.nullif(F.count_if(high), F.lit(0)), F.lit(0.0)), 4).alias("information_loss"),
    )
    loss = F.col("information_loss") if use_information_loss else F.col("filter_ratio")
    target = F.lit(float(settings.evidence_target))
    parts = {"top": F.col("top_score"), "evidence": F.least(F.col("evidence_count") / target, F.lit(1.0)), "strong": F.least(F.col("strong_count") / target, F.lit(1.0)), "retention": F.greatest(F.lit(0.0), 1 - loss)}
    value = round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted(parts, weights_of(settings)))))
    got = got.withColumn("confidence", F.when(F.col("kept_count") == 0, 0.0).otherwise(value))
    warn = F.col("filter_ratio") >= settings.filter_ratio_warn
    return got.withColumns({"quality_warning": warn, "needs_confirmation": (F.col("kept_count") == 0) | (F.col("confidence") < settings.confirm_threshold) | warn})


def mean_confidence(filtered: DataFrame) -> DataFrame:
    """The mean score of what was kept: a form that filtering alone can raise, kept for comparison."""
    return filtered.groupBy("query_id").agg(round4(F.coalesce(F.avg(F.when(F.col("kept"), F.col("score"))), F.lit(0.0))).alias("confidence"))
