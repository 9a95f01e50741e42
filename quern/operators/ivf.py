"""An inverted-file index of vectors: lists of near rows in files of their own, a few of which a query reads.

Centroids are k-means centres of a bounded sample of unit vectors; every row lies in the list of its nearest centre,
in a folder of its own. A query reads the lists of its nearest centres and ranks their rows exactly, so the result is that
of a full search wherever the true neighbours lie in those lists, and always if it asks for all lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.vector import Scorer, _matrix, _schema, _unit, unpacked
from .retrieval import vector_topk

#: Most rows that the centres are fitted on, and most lists (their centres go to every task).
FIT_ROWS, MOST_LISTS = 50_000, 65_536
#: A list is searched in parts of about so many rows.
PART_ROWS = 50_000


def _centres(rows: DataFrame, lists: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    picked = rows.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(FIT_ROWS)
    unit = Normalizer(inputCol="v", outputCol="features").transform(picked.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(unit.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return _unit(np.array(model.clusterCenters()))


def usable(rows: DataFrame) -> DataFrame:
    """Rows with a vector that has a direction: no null or non-finite component, not all zero."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(e.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(e, lambda x: x != 0))


def _nearest(centres: np.ndarray, probes: int, extra: list[str], schema: str):
    """For mapInArrow: each row once for each of its nearest lists, nearest first."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near = _unit(_matrix(b.column("embedding"))) @ centres.T
            lists = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(b.num_rows), lists.shape[1]))
            columns = [b.column(c).take(at) for c in extra] + [pa.array(lists.ravel().astype(np.int32)), pa.array(np.tile(np.arange(lists.shape[1], dtype=np.int32), b.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, [*extra, "list", "nth"])

    return run, f"{schema}, list int, nth int"


def build_index(corpus: DataFrame, path: str, lists: int, seed: int = 7) -> DataFrame:
    """Writes the index of corpus (chunk_id, embedding) under path; gives (list, rows). Rows without a usable vector are left out.

    All vectors are of one length. The write is one pass with a shuffle by list and part, so that a large list is
    written by several tasks.
    """
    if not 0 < lists <= MOST_LISTS:
        raise ValueError(f"between 1 and {MOST_LISTS} lists")
    spark, rows = corpus.sparkSession, usable(corpus.select("chunk_id", "embedding"))
    centres = _centres(rows, lists, seed)
    kind = corpus.schema["embedding"].dataType.simpleString()
    run, schema = _nearest(centres, 1, ["chunk_id", "embedding"], f"chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, embedding {kind}")
    placed = rows.mapInArrow(run, schema).drop("nth").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(16)))
    placed.repartition("list", "part").drop("part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    sizes = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.count("*").alias("rows"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    return spark.read.parquet(f"{path}/sizes")


def _read(spark: SparkSession, path: str) -> tuple[np.ndarray, dict[int, int]]:
    centres = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # MOST_LISTS rows at most, as are the sizes
    return np.array([r["centre"] for r in centres]), {r["list"]: r["rows"] for r in spark.read.parquet(f"{path}/sizes").collect()}


def search(queries: DataFrame, path: str, k: int = DEFAULTS.top_k, probes: int = 8, skip_self: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest rows of each query's nearest lists, as vector_topk gives them.

    Only the folders of lists that some query asks for are read. Queries meet the rows in one shuffle by list
    and part of a list; a list that holds much of the corpus has as many parts as its size asks for.
    """
    spark = queries.sparkSession
    centres, sizes = _read(spark, path)
    stored = spark.read.parquet(f"{path}/lists")
    parts = F.create_map(*[F.lit(x) for i, n in sizes.items() if n > PART_ROWS for x in (i, -(-n // PART_ROWS))]) if any(n > PART_ROWS for n in sizes.values()) else None
    split = (lambda c: F.coalesce(F.element_at(parts, c), F.lit(1))) if parts is not None else (lambda c: F.lit(1))
    asked = usable(queries.select("query_id", "embedding"))
    kinds = {c: queries.schema[c].dataType.simpleString() for c in ("query_id", "embedding")}
    run, schema = _nearest(centres, min(probes, len(centres)), ["query_id", "embedding"], f"query_id {kinds['query_id']}, embedding {kinds['embedding']}")
    probed = asked.mapInArrow(run, schema)
    wanted = [r["list"] for r in probed.select("list").distinct().collect()]  # MOST_LISTS at most
    left = probed.select("list", F.struct("query_id", "embedding").alias("asked")).withColumn("part", F.explode(F.sequence(F.lit(0), split(F.col("list")) - 1)))
    right = stored.where(F.col("list").isin(wanted)).withColumn("part", F.pmod(F.xxhash64("chunk_id"), split(F.col("list"))).cast("int"))
    out, types = _schema(queries, stored)
    empty = pa.RecordBatch.from_pylist([], pa.schema([*types.items(), ("similarity", pa.float64())]))

    def cell(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found, asked = [], unpacked(asked)
        if asked is None or "embedding" not in rows.schema.names:
            return pa.Table.from_batches([empty])
        for lo in range(0, asked.num_rows, 4096):
            block = Scorer(asked.slice(lo, 4096), k, (), skip_self)
            block.add(rows)
            found.append(block.best(types) or empty)
        return pa.Table.from_batches(found)

    hits = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInArrow(cell, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    scored = hits.select("query_id", "chunk_id", F.round("similarity", 4).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probes_for(corpus: DataFrame, path: str, k: int = DEFAULTS.top_k, recall: float = 0.95, asked: int = 256, seed: int = 11) -> int:
    """How many lists a query has to read so that it finds this share of its k nearest rows, by some rows of the corpus as queries."""
    spark = corpus.sparkSession
    centres, _ = _read(spark, path)
    some = usable(corpus.select(F.col("chunk_id").alias("query_id"), "embedding")).orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(asked)
    true = vector_topk(some, corpus, k, skip_self=True).select("query_id", "chunk_id")
    kind = corpus.schema["chunk_id"].dataType.simpleString()
    run, schema = _nearest(centres, len(centres), ["query_id"], f"query_id {kind}")
    order = some.mapInArrow(run, schema)
    where = spark.read.parquet(f"{path}/lists").select("chunk_id", "list")
    nth = true.join(where, "chunk_id").join(order, ["query_id", "list"]).select("nth")
    found = sorted(r["nth"] for r in nth.collect())  # asked * k numbers
    return found[min(len(found) - 1, int(np.ceil(recall * len(found))))] + 1 if found else len(centres)


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: (expected, found, recall) of the hits (query_id, chunk_id) against exact ones."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").withColumn("there", F.lit(True)), ["query_id", "chunk_id"], "left")
    return both.agg(F.count("*").alias("expected"), F.count("there").alias("found")).withColumn("recall", F.col("found") / F.nullif(F.col("expected"), F.lit(0)))


def share_read(queries: DataFrame, path: str, probes: int) -> DataFrame:
    """One row: the share of all rows that a query's lists hold, on average."""
    centres, sizes = _read(queries.sparkSession, path)
    run, schema = _nearest(centres, min(probes, len(centres)), ["query_id"], f"query_id {queries.schema['query_id'].dataType.simpleString()}")
    size = queries.sparkSession.createDataFrame(sorted(sizes.items()) or [(0, 0)], "list int, rows long")
    read = usable(queries).select("query_id", "embedding").mapInArrow(run, schema).join(F.broadcast(size), "list", "left")
    return read.agg((F.sum(F.coalesce("rows", F.lit(0))) / F.count_distinct("query_id") / F.lit(max(1, sum(sizes.values())))).alias("share"))
