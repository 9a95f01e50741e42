"""Sinks: JSON lines, parquet, keyed writes, reports, callbacks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators.ingest import not_yet_saved, upsert_latest


def write_jsonl(df: DataFrame, path: str) -> int:
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path).count()


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the target lacks; running it again appends nothing."""
    spark = df.sparkSession
    try:
        saved = spark.read.parquet(path).select(key)
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        df.write.parquet(path)
        return spark.read.parquet(path).count()
    before = saved.count()
    not_yet_saved(df, saved, key).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def merge_keyed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return upsert_latest(both, key, ["_new"]).drop("_new")


def few(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a report, which one reads: more than most are refused, none is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write the table instead")
    return rows


def write_parquet(df: DataFrame, path: str) -> int:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def keyword_text_report(report: dict) -> str:
    """The keyword report (a row of keyword_report and its recurring keywords) for people."""
    lines = [f"PRs: {report['pr_count']}", f"keywords: {report['total_keywords']}", f"failed calls: {report['error_count']}", f"important: {report['important_rate'] * 100:.1f}%", f"from background knowledge: {report['background_inference_rate'] * 100:.1f}%", "", "important in several PRs:"]
    return "\n".join(lines + ([f"  - {k} ({n})" for k, n in report["recurring"]] or ["  (none)"]))


def measurement_dump(df: DataFrame, path: str) -> int:
    """Measurement rows as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return df.sparkSession.read.json(path).count()


def text_report(aggregates: DataFrame, verdicts: DataFrame) -> str:
    """A Markdown table of a few runs and their verdicts."""
    rows = [r.asDict() for r in few(aggregates.orderBy("run"))]
    names = list(rows[0]) if rows else []
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)] + ["| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(lines + [f"- {r['run']}: {r['verdict']}" for r in few(verdicts.orderBy("run"))])


def json_report(aggregates: DataFrame, verdicts: DataFrame) -> str:
    rows = lambda df: [r.asDict(True) for r in few(df.orderBy("run"))]
    return json.dumps({"runs": rows(aggregates), "verdicts": rows(verdicts)}, ensure_ascii=False, default=str)


def send_with_retry(send: Callable[[str], None], body: str, attempts: int = DEFAULTS.callback_attempts, wait: Callable[[float], None] = time.sleep) -> None:
    """Calls send, waiting 1, 2, ... seconds between failures; the last failure is raised."""
    for k in range(attempts):
        try:
            return send(body)
        except Exception:
            if k + 1 == attempts:
                raise
            wait(k + 1)


def callback_sink(send: Callable[[str], None]):
    """For foreachBatch: every finished job of a batch goes out as JSON, from the executors."""

    def each(batch: DataFrame, _: int) -> None:
        batch.select(F.to_json(F.struct("*")).alias("body")).foreachPartition(lambda rows: [send_with_retry(send, r["body"]) for r in rows])

    return each
