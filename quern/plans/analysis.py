"""The whole analysis as one plan: retrieval, sufficiency, filter, confidence, and the gate before generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as tx
from ..operators.confidence import confidence
from ..operators.filtering import context_filter, filter_outcome
from ..operators.retrieval import retrieve_with_signals


def analyse(queries: DataFrame, reviews: DataFrame, repos: DataFrame | None = None, settings: Settings = DEFAULTS, mode: str | None = None, decisions: DataFrame | None = None, skip_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one row a query, its hits with kept).

    queries: query_id, diff, embedding. A blank diff retrieves nothing, has confidence 0 and needs confirmation. The
    filter runs before the gate: insufficient queries are filtered too, only generation is spared.
    """
    asked = queries.where(tx.strip(F.coalesce("diff", F.lit(""))) != "")
    merged, enough = retrieve_with_signals(asked, reviews, repos, settings, skip_self)
    ranked = merged.drop("rank").withColumnRenamed("merged_rank", "rank")
    filtered = context_filter(ranked, mode or settings.filter_mode, settings.sim_threshold, decisions=decisions)
    conf = confidence(filtered, settings).select("query_id", "confidence", "quality_warning", "needs_confirmation", "strong_count")
    outcome = filter_outcome(filtered, settings.sim_threshold).select("query_id", "n_kept", "filter_ratio", "information_loss")
    got = queries.select("query_id").join(enough, "query_id", "left").join(outcome, "query_id", "left").join(conf, "query_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("retrieved", "above_threshold", "n_kept", "strong_count")}
    got = got.withColumns({**zero, "confidence": F.coalesce("confidence", F.lit(0.0)), "sufficient": F.coalesce("sufficient", F.lit(False)), "reason": F.coalesce("reason", F.lit("no results")), "quality_warning": F.coalesce("quality_warning", F.lit(False)), "needs_confirmation": F.coalesce("needs_confirmation", F.lit(True))})
    return got, filtered


def generate(trace: DataFrame, generator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """trace with the generator's columns for sufficient queries; the others never reach it."""
    made = generator(trace.where("sufficient"))
    new = [c for c in made.columns if c not in trace.columns]
    return made.unionByName(trace.where("not sufficient").select("*", *(F.lit(None).cast(made.schema[c].dataType).alias(c) for c in new)), allowMissingColumns=True)
