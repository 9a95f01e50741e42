"""Ingest as a stream: micro-batches of new files, each written once whatever is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """New JSON lines files under path, some in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def batch_sink(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch goes to a folder of its own number and overwrites what an earlier try of it left there."""

    def each(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def run_available(source: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Ingests all that is there now and stops; called again, it goes on where the last commit ended."""
    query = source.writeStream.foreachBatch(sink or batch_sink(path, prepare)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_ingested(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """All ingested rows; with key, of a key that came in several batches the row of the latest."""
    from ..operators.ingest import upsert_latest

    rows = spark.read.option("basePath", path).parquet(path)
    rows = upsert_latest(rows, [key], ["batch"]) if key else rows
    return rows.withColumn("batch", F.col("batch").cast("long"))
