"""A keyed table with upserts and deletes: snapshots of bucket folders, one manifest each.

Rows lie in buckets by a hash of their key. A change rewrites the buckets that it touches into a folder of its own and
then commits a manifest that names a folder for each bucket. Readers follow the newest manifest, so they see one
state, before the change or after it. A write that fails leaves no manifest; a writer that another one has overtaken
finds the next manifest there and fails. Earlier snapshots stay readable until vacuum().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import upsert_latest


class Conflict(RuntimeError):
    """Another writer committed first; read again and retry."""


class KeyedStore:
    """A table under path with one row for each key; null is a key like others."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, buckets: int = 32):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/manifests")
        return sorted(int(x.getPath().getName().split(".")[0]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "buckets": {bucket: folder}, "counts"}; version 0 is the empty table."""
        there = self.versions()
        version = (there[-1] if there else 0) if version is None else version
        if version == 0:
            return {"version": 0, "buckets": {}, "counts": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{version:09d}.json", wholetext=True).first()
        return json.loads(text[0])

    def _commit(self, manifest: dict) -> None:
        fs, at = self._fs(f"{self.path}/manifests/{manifest['version']:09d}.json")
        _, part = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        fs.mkdirs(at.getParent())
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # Neither a rename onto an existing file nor a second winner is possible where rename is atomic.
        if fs.exists(at) or not fs.rename(part, at):
            fs.delete(part, False)
            raise Conflict(f"version {manifest['version']} is there already")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._folders(m, list(m["buckets"]))

    def _folders(self, m: dict, buckets: list) -> DataFrame:
        paths = [m["buckets"][str(b)] for b in buckets if str(b) in m["buckets"]]
        schema = self.spark.createDataFrame([], self.schema).schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _apply(self, change: DataFrame, merge) -> dict:
        """Rewrites the touched buckets by merge(old rows, change); gives the new manifest."""
        m = self.manifest()
        touched = [r[0] for r in change.select(self._bucket()).distinct().collect()]  # self.buckets at most
        if not touched:
            return m
        old = self._folders(m, touched)
        folder = f"data/{m['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        merged = merge(old, change).select(*self.columns).withColumn("_bucket", self._bucket())
        merged.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, at = self._fs(f"{self.path}/{folder}")
        written = {x.getPath().getName().split("=")[1] for x in fs.listStatus(at) if "=" in x.getPath().getName()}
        buckets = {b: p for b, p in m["buckets"].items() if int(b) not in touched} | {b: f"{folder}/_bucket={b}" for b in written}
        new = {"version": m["version"] + 1, "buckets": buckets, "touched": sorted(touched)}
        self._commit(new)
        return new

    def upsert(self, rows: DataFrame, newest: list[str] | None = None) -> dict:
        """rows replace the stored ones of their key, unless newest names columns by which the greater row wins.

        rows has one row for each key, or newest to choose by.
        """

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            if newest:
                return upsert_latest(old.unionByName(new), self.key, newest)
            same = [old[c].eqNullSafe(new[c]) for c in self.key]
            on = same[0]
            for s in same[1:]:
                on = on & s
            return old.join(new, on, "left_anti").unionByName(new)

        return self._apply(rows.select(*self.columns), merge)

    def delete(self, keys: DataFrame) -> dict:
        def merge(old: DataFrame, gone: DataFrame) -> DataFrame:
            on = old[self.key[0]].eqNullSafe(gone[self.key[0]])
            for c in self.key[1:]:
                on = on & old[c].eqNullSafe(gone[c])
            return old.join(gone, on, "left_anti")

        return self._apply(keys.select(*self.key).distinct(), merge)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the newest manifests and the folders that none of those names; gives how many folders went."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        used = {p for m in kept for p in m["buckets"].values()}
        fs, at = self._fs(f"{self.path}/data")
        gone = 0
        for folder in fs.listStatus(at) if fs.exists(at) else []:
            for bucket in fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{bucket.getPath().getName()}"
                if "=" in name and name not in used:
                    fs.delete(bucket.getPath(), True)
                    gone += 1
        for v in versions[:-keep]:
            fs.delete(self._fs(f"{self.path}/manifests/{v:09d}.json")[1], False)
        return gone
