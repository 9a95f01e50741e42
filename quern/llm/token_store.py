"""Token ids in a columnar binary format: fixed-size blocks as bit or byte planes, compressed, with a chunk index.

A store is a folder with two tables. ``chunks`` holds one row a chunk: a run of
whole documents in ascending id order, their ids cut into blocks of BLOCK ids
(the last block of a chunk may be shorter), each block transposed into planes
(4 byte planes or 32 bit planes of its little-endian 32-bit ids), every plane
compressed with zstandard on its own; a plane of zeros takes no bytes. ``index``
holds the same rows without their payload: shard, chunk, ids before it in the
shard, counts, first and last document, and the plane sizes, so that a reader
finds a document's chunk without touching others. Shards are ranges of document
ids; a table is the carrier of the rows because its commit survives lost
executors and repeated tasks.

Null and empty texts have their end id only; a text may have any length (a chunk is at least
one document). Null ids come first; rows of one id follow each other by text, so
ties have one order; repeated rows keep all their rows; an empty table gives an
empty store; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, parts, table
from .tokens import encoder

BLOCK, CHUNK = 16_384, 262_144
CHUNKS = "shard int, chunk int, before long, n_ids long, first_doc long, last_doc long, n_docs int, planes string, doc_ids binary, doc_known binary, doc_lens binary, plane_sizes array<int>, payload binary"
INDEX = ["shard", "chunk", "before", "n_ids", "first_doc", "last_doc", "n_docs", "planes", "plane_sizes"]


def to_planes(ids: np.ndarray, planes: str = "byte") -> np.ndarray:
    """A block of ids as rows of bytes: 4 byte planes (lowest first) or 32 bit planes (highest first)."""
    if planes == "byte":
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.packbits(np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1).T, axis=1)


def from_planes(rows: np.ndarray, n: int, planes: str = "byte") -> np.ndarray:
    if planes == "byte":
        return np.ascontiguousarray(rows.T).view("<u4").ravel()
    return np.ascontiguousarray(np.packbits(np.unpackbits(rows, axis=1)[:, :n].T, axis=1)).view(">u4").ravel().astype("<u4")


def encode_ids(ids: np.ndarray, planes: str = "byte", level: int = 1) -> tuple[list[int], bytes]:
    """(the compressed size of each plane of each block, all planes one after the other)."""
    press, sizes, out = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), BLOCK):
        for row in to_planes(ids[at : at + BLOCK], planes):
            data = press.compress(row.tobytes()) if row.any() else b""
            sizes.append(len(data))
            out.append(data)
    return sizes, b"".join(out)


def decode_ids(n: int, sizes: list[int], payload: bytes, planes: str = "byte") -> np.ndarray:
    """The inverse of encode_ids for n ids."""
    un, per, out, at = zstandard.ZstdDecompressor(), 4 if planes == "byte" else 32, [], 0
    for k, start in enumerate(range(0, n, BLOCK)):
        m = min(BLOCK, n - start)
        width = m if planes == "byte" else (m + 7) // 8
        rows = np.zeros((per, width), np.uint8)
        for p, size in enumerate(sizes[k * per : (k + 1) * per]):
            if size:
                rows[p] = np.frombuffer(un.decompress(payload[at : at + size], max_output_size=width), np.uint8)
            at += size
        out.append(from_planes(rows, m, planes))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def encode_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, planes: str = "byte") -> DataFrame:
    """The chunk rows of df's texts, each with end_id after it, in ascending order of id over shards and chunks."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        codec, shard, chunk, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[bytes] = []
        size = 0

        def emit():
            nonlocal chunk, before, size
            ids = np.frombuffer(b"".join(held), "<u4")
            sizes, payload = encode_ids(ids, planes)
            known = [d for d in docs if d is not None]
            row = {"shard": shard, "chunk": chunk, "before": before, "n_ids": len(ids), "first_doc": min(known, default=None), "last_doc": max(known, default=None), "n_docs": len(docs), "planes": planes}
            row |= {"doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "doc_known": np.array([d is not None for d in docs], np.uint8).tobytes(), "doc_lens": np.array([len(h) // 4 for h in held], "<i8").tobytes(), "plane_sizes": sizes, "payload": payload}
            chunk, before, size = chunk + 1, before + len(ids), 0
            docs.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for at in range(0, b.num_rows, 256):
                for d, data in zip(ids[at : at + 256], codec.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    docs.append(d)
                    held.append(data + end)
                    size += len(data) // 4 + 1
                    if size >= CHUNK:
                        yield emit()
        if docs:
            yield emit()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(parts(df.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(run, CHUNKS)


SCHEMA = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("planes", pa.string()), ("doc_ids", pa.binary()), ("doc_known", pa.binary()), ("doc_lens", pa.binary()), ("plane_sizes", pa.list_(pa.int32())), ("payload", pa.binary())])


def write_store(df: DataFrame, path: str, **options) -> str:
    """Writes df's texts as a token store into the folder path."""
    encode_chunks(df, **options).write.option("compression", "none").mode("overwrite").parquet(f"{path}/chunks")
    df.sparkSession.read.parquet(f"{path}/chunks").select(*INDEX).write.mode("overwrite").parquet(f"{path}/index")
    return path


def read_store(spark: SparkSession, path: str, each=None, schema: str = "doc_id long, start long, ids array<long>", only=None) -> DataFrame:
    """Every document of a store: doc_id, the ids of all documents before it, and each(ids) (by default the ids). only: a condition on the chunks to read."""
    each = each or (lambda ids: (ids.tolist(),))
    totals = sorted(spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # one row a shard
    base, at = {}, 0
    for r in totals:
        base[r["shard"]], at = at, at + r["n"]
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                ids = decode_ids(r["n_ids"], r["plane_sizes"], r["payload"], r["planes"])
                docs, known, lens = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_known"], np.uint8), np.frombuffer(r["doc_lens"], "<i8")
                ends = np.cumsum(lens)
                first = base[r["shard"]] + r["before"]
                rows = [(int(d) if w else None, int(first + e - n), *each(ids[e - n : e])) for d, w, n, e in zip(docs, known, lens.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))

    chunks = spark.read.parquet(f"{path}/chunks")
    return (chunks if only is None else chunks.where(only)).select("shard", "before", "n_ids", "planes", "plane_sizes", "payload", "doc_ids", "doc_known", "doc_lens").mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, start, ids) of the documents with the given ids, from the chunks that the index says may hold them."""
    index = spark.read.parquet(f"{path}/index")
    wanted = F.lit(False)
    for i in ids:
        wanted = wanted | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
    chunks = [(r["shard"], r["chunk"]) for r in index.where(wanted).select("shard", "chunk").collect()]  # few for each id
    named = F.struct("shard", "chunk").isin(*(F.struct(F.lit(s), F.lit(c)) for s, c in chunks)) if chunks else F.lit(False)
    return read_store(spark, path, only=named).where(F.col("doc_id").isin(*ids))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: writes a store of every document and reads it back."""
    path = write_store(table(spark, sf_dir, "documents"), f"{Scratch(spark, 'tokens').root}/store")
    digest = lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    return read_store(spark, path, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
