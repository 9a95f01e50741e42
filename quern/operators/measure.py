"""Measurement and exploration: sweeps, medians, spreads, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import round4


def upper_median_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upper medians without collecting a group: values are counted first, and the running count finds the place."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    run = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"_run": run, "_at": F.floor(F.sum("_n").over(w) / 2)})
    return placed.where("_run > _at and _run - _n <= _at").select(*keys, F.col(value).alias("upper_median"))


def threshold_sweep(best: DataFrame, score: str = "top_score", thresholds: tuple[float, ...] = DEFAULTS.threshold_candidates) -> DataFrame:
    """For each candidate threshold how many rows pass; one scan, one row a threshold."""
    got = best.select(F.col(score).alias("s"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return got.groupBy("threshold").agg(F.count_if(F.col("s") >= F.col("threshold")).alias("passed"), F.count_if(~(F.coalesce("s", F.lit(0.0)) >= F.col("threshold"))).alias("skipped"), F.round(F.count_if(F.col("s") >= F.col("threshold")) / F.count("*"), 4).alias("ratio"))


def describe_lengths(df: DataFrame, key: str, length: str) -> DataFrame:
    """Count, mean, sample deviation, least, percentiles (interpolated) and greatest of a length per key."""
    p = F.percentile(length, F.array(*map(F.lit, (0.5, 0.75, 0.9, 0.95, 0.99))))
    got = df.groupBy(key).agg(F.count(length).alias("n"), F.round(F.avg(length), 4).alias("mean"), F.round(F.stddev_samp(length), 4).alias("std"), F.min(length).alias("least"), p.alias("p"), F.max(length).alias("most"))
    names = ("p50", "p75", "p90", "p95", "p99")
    return got.select(key, "n", "mean", "std", "least", *(F.round(F.col("p")[i], 4).alias(x) for i, x in enumerate(names)), "most")


def run_stability(repeats: DataFrame, key: list[str], score: str, threshold: float) -> DataFrame:
    """Spread of repeated scores, and whether the decision flips between repeats."""
    return repeats.groupBy(*key).agg(F.count("*").alias("repeats"), F.round(F.max(score) - F.min(score), 4).alias("spread"), (F.count_distinct(F.col(score) >= threshold) > 1).alias("flipped"))


def cost_estimate(df: DataFrame, text: str, usd_per_million: float = 0.02) -> DataFrame:
    """Rows, characters, a quarter of them as tokens, and what these cost."""
    tokens = F.floor(F.coalesce(F.sum(F.length(text)), F.lit(0)) / 4).cast("long")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), tokens.alias("tokens"), F.round(tokens / 1_000_000 * usd_per_million, 4).alias("usd"))


def variant_stats(rows: DataFrame, variant: str, score: str, high: float = 0.8, fair: float = 0.6) -> DataFrame:
    """Of each variant how many scores, their mean and upper median, and how many reach the two marks."""
    got = rows.groupBy(variant).agg(F.count(score).alias("n"), round4(F.avg(score)).alias("mean"), F.count_if(F.col(score) >= high).alias("n_high"), F.count_if(F.col(score) >= fair).alias("n_fair"))
    return got.join(upper_median_by(rows, [variant], score).withColumnRenamed("upper_median", "median"), variant, "left")
