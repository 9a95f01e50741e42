"""The job lifecycle as a fold over events, its timeout and its retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COMPLETED, DEFAULTS, FAILED, PROCESSING, TERMINAL

TIMED_OUT = "the job ran out of time"
JOB = "job_id string, analysis_id long, status string, started_at timestamp, completed_at timestamp, error_message string"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def latest_state(events: DataFrame, job: str = "job_id", at: str = "ts", order: str = "event_id") -> DataFrame:
    """One row a job from (job, status, ts, event): the last terminal event after the last start wins.

    A start of a known id begins its job anew; one terminal state may follow another. Jobs never seen starting
    take no updates.
    """
    done = F.col("status").isin(*TERMINAL)
    e = F.struct(F.col(at).alias("ts"), F.col(order).alias("o"), F.col("status").alias("s"))
    started = F.max(F.when(F.col("status") == PROCESSING, e))
    got = events.groupBy(job).agg(started.alias("first"), F.max(F.when(done, e)).alias("last"), F.count("*").alias("n_events"))
    # Terminal events before the job's start are updates of an unknown job.
    known = got.where(F.col("first").isNotNull())
    ok = F.col("last").isNotNull() & ((F.col("last.ts") > F.col("first.ts")) | ((F.col("last.ts") == F.col("first.ts")) & (F.col("last.o") > F.col("first.o"))))
    return known.select(
        job,
        F.when(ok, F.col("last.s")).otherwise(PROCESSING).alias("status"),
        F.col("first.ts").alias("started_at"),
        F.when(ok, F.col("last.ts")).alias("completed_at"),
        "n_events",
    )


def is_stale(now: Column, minutes: int = DEFAULTS.job_timeout_minutes) -> Column:
    if minutes <= 0:
        return F.lit(False)
    return (F.col("status") == PROCESSING) & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes)))


def reap_stale(jobs: DataFrame, now: Column, minutes: int = DEFAULTS.job_timeout_minutes) -> DataFrame:
    """Jobs that ran out of time fail; running it again changes nothing."""
    stale = is_stale(now, minutes)
    return jobs.select(*[c for c in jobs.columns if c not in ("status", "completed_at")], F.when(stale, FAILED).otherwise(F.col("status")).alias("status"), F.when(stale, now).otherwise(F.col("completed_at")).alias("completed_at"), stale.alias("reaped"))


def read_job(jobs: DataFrame, ids: DataFrame, now: Column, minutes: int = DEFAULTS.job_timeout_minutes) -> DataFrame:
    """The asked jobs (job_id) as a reader sees them: one that ran out of time has failed already, though no sweep came by."""
    seen = reap_stale(jobs.join(ids.select("job_id").distinct(), "job_id", "left_semi"), now, minutes)
    return seen.select("job_id", "status", iso(F.col("started_at")).alias("started_at"), iso(F.col("completed_at")).alias("completed_at"), F.when(F.col("reaped"), TIMED_OUT).alias("error_message"))


def purge_old(jobs: DataFrame, now: Column, days: int = DEFAULTS.job_retention_days) -> DataFrame:
    """Jobs without the terminal ones completed before the retention; 0 days keeps all."""
    if days <= 0:
        return jobs
    old = F.col("status").isin(*TERMINAL) & F.col("completed_at").isNotNull() & (F.col("completed_at") < now - F.make_dt_interval(days=F.lit(days)))
    return jobs.where(~old)


def maintenance(jobs: DataFrame, now: Column, minutes: int = DEFAULTS.job_timeout_minutes, days: int = DEFAULTS.job_retention_days) -> DataFrame:
    """One row: how many jobs time out and how many are purged."""
    reaped = reap_stale(jobs, now, minutes)
    old = F.lit(False) if days <= 0 else F.col("status").isin(*TERMINAL) & F.col("completed_at").isNotNull() & (F.col("completed_at") < now - F.make_dt_interval(days=F.lit(days)))
    return reaped.agg(F.count_if("reaped").alias("reaped"), F.count_if(old).alias("purged"), F.count("*").alias("jobs"))


def init_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The job table at path, made empty if there is none."""
    spark.createDataFrame([], JOB).write.mode("ignore").parquet(path)
    return spark.read.schema(JOB).parquet(path)


def classify_failure(error: Column) -> Column:
    """The failure code of an error's class name."""
    return F.when(error == "RetrievalError", "RETRIEVAL_FAILED").when(error == "LLMResponseParseError", "LLM_RESPONSE_INVALID").otherwise("ANALYSIS_FAILED")


__all__ = ["COMPLETED", "FAILED", "PROCESSING", "classify_failure", "is_stale", "iso", "latest_state", "maintenance", "purge_old", "reap_stale"]
