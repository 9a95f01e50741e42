"""Shared helpers: table access, shared storage, hashing splits, Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word rules define it: bytes.split() splits exactly at these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``; only where that is unset in a local run
    (tests) a temporary folder is made and set. On a cluster a folder of this
    machine would be another one on each executor, so it must be set there.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


@contextlib.contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the plans that run inside; the earlier ones come back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files go as soon as the written table is there, since nothing else reads them.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: For tables whose rows are megabytes: Parquet counts bytes after 100 rows only, and its reader holds up to 4096 rows of a row group.
LARGE_ROWS = {"parquet.block.row.count.limit": "1"}
#: What goes to and from Python at once, besides one row of any size.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


class Scratch:
    """Written tables in the shared folder, so that lineage is cut and a lost executor loses nothing.

    Results are lazy and may read them as long as the session lives; when the driver's process ends, they are deleted.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.close)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        """Deletes all tables; of no effect where the session has ended before."""
        with contextlib.suppress(Exception):
            self._delete(self.root)

    def write(self, df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.mode("overwrite").options(**(options or {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def settle(self, df: DataFrame, settings: dict[str, str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
        """write(), more densely, after which the shuffle files of df are deleted."""
        with session_conf(self.spark, TIDY | {"spark.sql.parquet.compression.codec": "zstd"} | (settings or {})):
            return self.write(df, options)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in frames:
            self._delete(df._scratch_path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: Column, n: int) -> Column:
    """crc32(id as text) mod n; null ids count as remainder 0 of the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def crc_mod_py(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str, setup: Callable | None = None) -> DataFrame:
    """Applies fn to every Arrow batch; setup() runs once a task and its value goes to fn."""

    def run(batches):
        state = (setup(),) if setup else ()
        for b in batches:
            if not b.num_rows:
                continue
            out = fn(b, *state)
            if out is None:
                continue
            yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8, A-Z lower-cased (bytes.lower touches ASCII only)."""
    return (text or "").encode("utf-8", "replace").lower().split()


def prefer_local_threads() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def safe_tag(name: str) -> str:
    return re.sub(r"\W+", "-", name)
