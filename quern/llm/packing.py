"""Sequence packing as a cutting-stock problem solved by column generation.

A document's ids (with an end id) are cut into full pieces of the sequence
length and one remainder. Remainders are counted in a histogram of length
classes (``width`` tokens wide). If whole remainders would pad more than ``waste`` of the sequences that the
tokens need at least, as those of 1025 tokens or very short ones do, remainders are cut at powers of two down to
``finest``, classes are one token wide, and the same program packs the parts. A linear program over patterns (how many pieces of
each class lie in one sequence) is solved on the driver by column generation: a
knapsack dynamic program over the duals prices new patterns until none improves.
Patterns are rounded down, what is left is placed first-fit by falling class, and
the pieces, ranked within their class over the whole table, take the slots of
the patterns. The driver sees only the histogram (at most length/width rows);
ranks come from counts by class and shard, never from one task's sort.

Null and empty texts are one end id; a text may have any length. Repeated rows and ids are
packed each; equal pieces of equal ids are ranked in any order, which gives the same rows. Other columns are left
aside, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_batches, parts, table
from .tokens import Encoder, encoder


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming over the room."""
    value = np.zeros(room + 1)
    full = np.full(room + 1, -np.inf)
    full[sizes] = duals
    last = np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        gain = value[c - 1 :: -1][:c] + full[1 : c + 1]  # size s leaves c - s
        s = int(gain.argmax())
        if gain[s] > value[c - 1] + 1e-12:
            value[c], last[c] = gain[s], s + 1
        else:
            value[c] = value[c - 1]
    pattern, at, where = np.zeros(len(sizes), np.int64), room, {int(s): i for i, s in enumerate(sizes)}
    while at > 0:
        if last[at]:
            pattern[where[int(last[at])]] += 1
            at -= int(last[at])
        else:
            at -= 1
    return float(value[room]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with pivoting in plain array operations: threaded LAPACK can stall in a process that also drives a JVM."""
    n = len(a)
    both = np.concatenate([a, np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        if p != k:
            both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[k]
    return both[:, n:]


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = 20_000, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each size) and how often each is used; together they hold exactly the demand."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(room // sizes).astype(float)
    soft = demand + 1e-2 * np.random.default_rng(0).random(m)  # a nudge, lest equal ratios make the simplex go in circles
    inverse, x = np.diag(1.0 / (room // sizes)), soft / (room // sizes)
    bound = 0.0
    for step in range(min(most, 60 * m + 600)):
        duals = np.maximum(inverse.sum(axis=0), 0)
        worth, column = price(duals, sizes, room)
        value = float(x.sum())
        bound = max(bound, float((duals * soft).sum()) / max(worth, 1.0))  # no plan needs fewer sequences
        if worth <= 1 + 1e-9 or value - bound < max(0.5, gap * value):
            break
        way = (inverse * column).sum(axis=1)
        ratio = np.where(way > 1e-7, x / np.where(way > 1e-7, way, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        out = int(np.where(ratio <= ratio.min() + 1e-9, way, -np.inf).argmax())
        basis[:, out] = column
        if step % 32 == 31:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
        x = np.maximum((inverse * soft).sum(axis=1), 0)
    left, found = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        pattern = basis[:, j].astype(np.int64)
        used = pattern > 0
        times = int(min(np.floor(x[j] + 1e-6), (left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            found.append((pattern, times))
            left -= times * pattern
    bins: list[list] = []  # first fit by falling size over what rounding left
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[i])):
            at = next((b for b in bins if b[0] >= sizes[i]), None)
            if at is None:
                bins.append(at := [room, np.zeros(m, np.int64)])
            at[0] -= int(sizes[i])
            at[1][i] += 1
    return found + [(b[1], 1) for b in bins]


PIECE = "start long, length long, ids_crc32 long"


def binary_parts(start: int, n: int, length: int, finest: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of a remainder: powers of two, falling, and a rest below finest."""
    out, size = [], length
    while n >= finest and size >= finest:
        if n >= size:
            out.append((start, size))
            start, n = start + size, n - size
        size //= 2
    return [*out, (start, n)] if n else out


def cut_pieces(df: DataFrame, id_col: str, text_col: str, length: int, tokenizer: str | None, end_id: int, finest: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, parts) for every piece; parts: of a remainder, as it would be cut, if that is not as it is."""
    end = int(end_id).to_bytes(4, "little")
    part = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    def run(batch: pa.RecordBatch, codec: Encoder):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for at in range(0, batch.num_rows, 1024):
            rows, parts = [], []
            for d, data in zip(ids[at : at + 1024], codec.encode(texts.slice(at, 1024).to_pylist()), strict=True):
                data += end
                n = len(data) // 4
                for s in range(0, n, length):
                    k = min(length, n - s)
                    rows.append((d, s, k, zlib.crc32(data[4 * s : 4 * (s + k)]), n))
                    cut = binary_parts(s, k, length, finest) if k < length else []
                    parts.append([(a, m, zlib.crc32(data[4 * a : 4 * (a + m)])) for a, m in cut] if len(cut) > 1 else None)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(parts, part)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id long, {PIECE}, doc_tokens long, parts array<struct<{PIECE.replace(' long', ': long')}>>", lambda: encoder(tokenizer))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, width: int = 8, tokenizer: str | None = None, end_id: int = 1, waste: float = 0.01, finest: int = 16) -> DataFrame:
    """The pieces of every document with their sequence and their place in it."""
    spark = df.sparkSession
    scratch, shards = Scratch(spark, "packing"), max(4, parts(spark) // 4)
    pieces = scratch.write(cut_pieces(df, id_col, text_col, length, tokenizer, end_id, finest))

    def counted(pieces: DataFrame, width: int) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray, int]:
        shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("int")
        pieces = pieces.withColumns({"cls": F.ceil(F.col("length") / width).cast("int"), "shard": shard})
        counts = scratch.write(pieces.groupBy("cls", "shard").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")))
        totals = sorted(tuple(r) for r in counts.groupBy("cls").agg(F.sum("n"), F.sum("tokens")).collect())  # at most length/width rows
        return pieces, counts, *np.array(totals, np.int64).reshape(-1, 3).T[:2], sum(t for _, _, t in totals)

    whole = pieces.drop("parts")
    pieces_, counts, sizes, demand, tokens = counted(whole, width)
    patterns = solve(sizes, demand, length // width)
    least = -(-tokens // length)
    if sum(times for _, times in patterns) > max((1 + waste) * least, least + 1):
        cut = F.coalesce("parts", F.array(F.struct("start", "length", "ids_crc32")))
        width = 1
        pieces_, counts, sizes, demand, tokens = counted(pieces.select("doc_id", "doc_tokens", F.explode(cut).alias("p")).select("doc_id", "p.*", "doc_tokens"), width)
        patterns = solve(sizes, demand, length)
    pieces = pieces_
    plan: dict[int, list] = {int(c): [] for c in sizes}
    filled, first = dict.fromkeys(plan, 0), 0
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern):
            c, k = int(sizes[i]), int(pattern[i])
            plan[c].append((filled[c], k, first))
            filled[c] += k * times
        first += times
    slots = {c: tuple(np.array(v, np.int64).T) for c, v in plan.items()}  # (first rank, pieces in a sequence, first sequence) of each pattern

    base = counts.select("cls", "shard", (F.sum("n").over(Window.partitionBy("cls").orderBy("shard")) - F.col("n")).alias("base"))
    order = Window.partitionBy("cls", "shard").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(order)).join(base, ["cls", "shard"]).withColumn("rank", F.col("base") + F.col("r") - 1)

    def place(batch: pa.RecordBatch):
        c, rank = batch.column("cls").to_numpy(), batch.column("rank").to_numpy()
        sequence, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for k in np.unique(c):
            at = np.flatnonzero(c == k)
            lo, each, seq = slots[int(k)]
            j = np.searchsorted(lo, rank[at], side="right") - 1
            local = rank[at] - lo[j]
            sequence[at], slot[at] = seq[j] + local // each[j], local % each[j]
        keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls"]
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(sequence), pa.array(slot)], [*keep, "sequence_id", "slot"])

    kept = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, sequence_id long, slot long"
    placed = map_batches(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank"), place, kept)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "slot")
    offset = (F.sum("length").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document packed into sequences of 2048."""
    return pack(table(spark, sf_dir, "documents"))
