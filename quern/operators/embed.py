"""The embedding stage: batches by token budget, one model a worker, waits by kind of error, failed rows kept apart.

A model is any callable that takes a list of texts and gives as many vectors. Its factory runs once in a Python worker and
its value stays for the tasks to come. What it raises decides: a RateLimited waits 5, 10, ... seconds, a Rejected
(the text itself is at fault) is not tried again, all else waits 3 seconds. A batch that is refused for good is
tried again text by text, so that one text never costs its neighbours their vectors.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

Model = Callable[[list[str]], list[list[float]]]

#: Fixed values of the reference's loader: tries a batch, seconds of a wait by kind of error.
TRIES, RATE_WAIT, OTHER_WAIT = 5, 5, 3


class RateLimited(Exception):
    """The service asks to come back later."""


class Rejected(Exception):
    """The service will not take this text, however often it is sent."""


_MODELS: dict[str, Model] = {}


def _model(name: str, make: Callable[[], Model]) -> Model:
    if name not in _MODELS:
        _MODELS[name] = make()
    return _MODELS[name]


def words(text: str) -> int:
    return len(text.split())


def batches_of(texts: list[str], count: Callable[[str], int], budget: int, most: int) -> list[list[int]]:
    """Places of texts in batches of at most budget tokens and most texts; a text beyond the budget goes alone."""
    out: list[list[int]] = []
    room = 0
    for k, t in enumerate(texts):
        n = count(t)
        if not out or n > room or len(out[-1]) >= most:
            out.append([])
            room = budget
        out[-1].append(k)
        room -= n
    return out


def attempt(model: Model, texts: list[str], tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> tuple[list | None, str | None, int]:
    """(vectors or None, the last error, how many tries it took)."""
    error = None
    for k in range(1, tries + 1):
        try:
            found = model(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found, None, k
        except Rejected as e:
            return None, f"Rejected: {e}", k
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if k < tries:
                wait(RATE_WAIT * k if isinstance(e, RateLimited) else OTHER_WAIT)
    return None, error, tries


def embed(
    rows: DataFrame, text: str, make: Callable[[], Model], name: str = "default", budget: int = 8000, most: int = 10,
    count: Callable[[str], int] = words, tries: int = TRIES, wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """rows with embedding, error (null where there is a vector) and tries.

    A null or blank text is not sent: it has neither vector nor error and 0 tries. Rows keep their order within a
    partition; how they are dealt to partitions decides what runs at the same time, so repartition first to bound
    the calls in flight.
    """
    added = [StructField("embedding", ArrayType(FloatType())), StructField("error", StringType()), StructField("tries", LongType())]
    clash = {f.name for f in added} & set(rows.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be hidden")
    schema = StructType([*rows.schema.fields, *added])
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches):
        model = _model(name, make)
        for b in batches:
            texts = b.column(text).to_pylist()
            sent = [k for k, t in enumerate(texts) if t and not t.isspace()]
            found: list[tuple] = [(None, None, 0)] * len(texts)
            for batch in batches_of([texts[k] for k in sent], count, budget, most):
                places = [sent[k] for k in batch]
                vectors, error, n = attempt(model, [texts[k] for k in places], tries, wait)
                if vectors is None and len(places) > 1 and (error or "").startswith("Rejected"):
                    for k in places:
                        one, why, more = attempt(model, [texts[k]], tries, wait)
                        found[k] = (one[0] if one else None, why, n + more)
                    continue
                for i, k in enumerate(places):
                    found[k] = (vectors[i] if vectors else None, error, n)
            columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *(f.name for f in added)])

    return rows.mapInArrow(run, schema)


def embed_query(queries: DataFrame, text: str, make: Callable[[], Model], name: str = "default", **options) -> DataFrame:
    """Queries with the vector to search by; one that can't be embedded stops the run, since it would find nothing."""
    got = embed(queries, text, make, name, **options)
    failed = F.col("error").isNotNull()
    vector = F.when(failed, F.raise_error(F.concat(F.lit("no vector for a query: "), F.col("error"))).cast("array<float>")).otherwise(F.col("embedding"))
    return got.select(*queries.columns, vector.alias("embedding"))


def ingest(rows: DataFrame, key: str, text: str, make: Callable[[], Model], path: str, name: str = "default", **options) -> dict[str, int]:
    """Embeds the rows whose key is not stored under path yet; gives how many were saved and how many failed.

    Vectors go to path/saved, rows without one to path/failed as of this run, in one pass over the rows (the pass is
    written to path/runs and split from there). What is saved is never embedded again, what failed is tried again by
    the next run, and a run that dies before its commit leaves nothing in path/saved.
    """
    from .ingest import not_yet_saved

    spark = rows.sparkSession
    saved = stored(spark, f"{path}/saved")
    todo = not_yet_saved(rows, saved, key) if saved is not None else rows
    run = f"{path}/runs"
    embed(todo, text, make, name, **options).write.mode("overwrite").parquet(run)
    done = spark.read.parquet(run)
    counts = done.agg(F.count("embedding").alias("saved"), F.count("error").alias("failed"), F.count("*").alias("rows")).first().asDict()
    done.where("error is not null").write.mode("overwrite").parquet(f"{path}/failed")
    done.where("embedding is not null").drop("error", "tries").write.mode("append").parquet(f"{path}/saved")
    return counts


def stored(spark, path: str) -> DataFrame | None:
    """The table at path, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def hashed_model(width: int = 8) -> Callable[[], Model]:
    """A deterministic stand-in without a network: counts of words by a checksum of their bytes."""

    def make() -> Model:
        import zlib

        def embed_texts(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = [0.0] * width
                for w in t.split():
                    v[zlib.crc32(w.encode()) % width] += 1.0
                out.append(v)
            return out

        return embed_texts

    return make
