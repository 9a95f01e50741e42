"""Vector expressions and batched scoring."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _matrix(column) -> np.ndarray:
    """Rows as doubles; straight from the Arrow values where all rows are of one length and nothing is null."""
    values = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and not column.null_count and not values.null_count and (sizes == sizes[0]).all():
        return values.to_numpy().astype(np.float64).reshape(len(column), -1)
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r is not None), default=0)
    out = np.full((len(rows), width), np.nan)
    for i, r in enumerate(rows):
        if r is not None and len(r) == width:
            out[i] = [np.nan if x is None else x for x in r]
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm > 0, norm, np.nan)


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as they are: whole numbers in 64 bits, never as floating-point numbers; all else as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _order(ids: np.ndarray) -> np.ndarray:
    """Numbers that order ids as Spark does, nulls first."""
    if ids.dtype != object:
        return ids
    there = np.array([x is not None for x in ids], bool)
    known = np.empty(int(there.sum()), object)
    known[:] = [tuple(x.values()) if isinstance(x, dict) else x for x in ids[there]]
    out = np.zeros(len(ids), np.int64)
    out[there] = np.unique(known, return_inverse=True)[1] + 1
    return out


def _places(s: np.ndarray) -> np.ndarray:
    """Ten thousand times the values rounded to four places as round() does: halves of the decimal text away from zero."""
    x = np.abs(s) * 1e4
    n = np.floor(x + 0.5)
    for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-6):
        n[i] = int(Decimal(repr(float(abs(s[i])))).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP))
    return (np.sign(s) * n).astype(np.int64)


@dataclass(frozen=True)
class Buckets:
    """Random projections of unit vectors cut into buckets: a row is looked at if it shares one with the query and lies within radius of it."""

    tables: int
    width: float
    radius: float
    seed: int = 1

    def of(self, unit: np.ndarray) -> np.ndarray:
        d = np.random.default_rng(self.seed).standard_normal((unit.shape[1], self.tables))
        return np.floor(np.nan_to_num(unit @ (d / np.sqrt((d * d).sum(0)))) / self.width).astype(np.int32)

    def leave_out(self, s: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> None:
        shared = np.zeros(s.shape, bool)
        for t in range(self.tables):
            shared |= mine[:, t, None] == theirs[None, :, t]
        s[~shared | (s <= 1 - self.radius**2 / 2)] = np.nan


class Scorer:
    """The k best rows for a block of queries, fed with batches of a corpus; holds a bounded number of rows a query, however many tie.

    The order is that of the cosine rounded to four places, then of the id, as in the window over all blocks' rows.
    """

    def __init__(self, queries: pa.Table, k: int, keys: tuple[str, ...] = (), skip_self: bool = False, near: Buckets | None = None):
        queries = queries.combine_chunks()
        column = lambda c: pa.concat_arrays(queries.column(c).chunks) if queries.num_rows else pa.array([], queries.schema.field(c).type)
        self.k, self.keys, self.skip_self, self.near = k, keys, skip_self, near
        self.ids, self.vectors = _ids(column("query_id")), _unit(_matrix(column("embedding")))
        self.own = list(zip(*(column(c).to_pylist() for c in keys), strict=True))
        self.buckets = near.of(self.vectors) if near and len(self.ids) else None
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, similarity, chunk
        self.size, self.least = 0, np.full(len(self.ids), -np.inf)  # what a row must reach to be among the k best

    def add(self, rows: pa.RecordBatch | pa.Table) -> None:
        """Scores rows (chunk_id, embedding, keys) in tiles of bounded size."""
        for b in rows.to_batches() if isinstance(rows, pa.Table) else [rows]:
            for lo in range(0, b.num_rows, TILE):
                self._tile(b.slice(lo, TILE))

    def _tile(self, b: pa.RecordBatch) -> None:
        if not len(self.ids):
            return
        b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("embedding")), self.vectors.shape[1]), False))
        if not b.num_rows:
            return
        theirs = _unit(_matrix(b.column("embedding")))
        s, chunk = self.vectors @ theirs.T, _ids(b.column("chunk_id"))
        if self.skip_self:
            s[self.ids[:, None] == chunk[None]] = np.nan
        if self.keys:
            of = list(zip(*(b.column(c).to_pylist() for c in self.keys), strict=True))
            number = {x: i for i, x in enumerate(dict.fromkeys([*self.own, *of]))}
            s[np.array([number[x] for x in self.own])[:, None] != np.array([number[x] for x in of])[None]] = np.nan
        if self.near:
            self.near.leave_out(s, self.buckets, self.near.of(theirs))
        s[np.isinf(s)] = np.nan
        new = np.flatnonzero(np.isneginf(self.least))
        if len(new) and self.k < s.shape[1]:
            first = s[new]
            first[np.isnan(first)] = -np.inf
            self.least[new] = np.partition(first, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - SLACK
        q, c = np.nonzero(s >= self.least[:, None])
        self.held.append((q, s[q, c], chunk[c]))
        self.size += len(q)
        if self.size > max(4 * self.k * len(self.ids), 1 << 16):
            self._shrink()

    def _shrink(self) -> None:
        """Keeps the k best rows of each query."""
        q, s, chunk = (np.concatenate(x) for x in zip(*self.held, strict=True))
        n = _places(s)
        order = np.lexsort((_order(chunk), -n, q))
        q, n = q[order], n[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        last, keep = place == self.k - 1, order[place < self.k]
        self.least[q[last]] = (n[last] - 0.5) / 1e4 - 1e-9
        self.held, self.size = [(q[place < self.k], s[keep], chunk[keep])], len(keep)

    def best(self, types: dict[str, pa.DataType]) -> pa.RecordBatch | None:
        if not self.size:
            return None
        self._shrink()
        q, s, chunk = self.held[0]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q], types["query_id"]), pa.array(chunk, types["chunk_id"]), pa.array(s, pa.float64())], ["query_id", "chunk_id", "similarity"])


#: Rows less similar than the k-th by more than this round to less at four places.
SLACK = 1.1e-4
#: Rows that are scored at once.
TILE = 512
#: Most bytes of query vectors that are sent to every task at once.
SENT_BYTES = 64 << 20


def unpacked(packed: pa.Table) -> pa.Table | None:
    """Queries from the column that packs them; None for a side without rows, which comes without columns."""
    if "asked" not in packed.schema.names:
        return None
    return pa.Table.from_batches([pa.RecordBatch.from_struct_array(c) for c in packed.column("asked").chunks])


def _schema(queries: DataFrame, corpus: DataFrame) -> tuple[str, dict[str, pa.DataType]]:
    kinds = {c: df.schema[c].dataType for df, c in ((queries, "query_id"), (corpus, "chunk_id"))}
    return f"query_id {kinds['query_id'].simpleString()}, chunk_id {kinds['chunk_id'].simpleString()}, similarity double", {c: to_arrow_type(t) for c, t in kinds.items()}


def best_candidates(corpus: DataFrame, queries: DataFrame, k: int, keys: tuple[str, ...] = (), skip_self: bool = False, sent_bytes: int = SENT_BYTES, tile: int = 4096, near: Buckets | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity): for each query the k nearest rows of each task's or cell's share of corpus, by cosine at four places, then by id.

    queries has query_id, embedding and the key columns; corpus has chunk_id, embedding and the key columns; ids are of
    any type and come back as they are. Rows with another key are no candidates, nor with skip_self those with the
    query's own id (for queries that are rows of the corpus). Null and zero vectors, and vectors of another
    length than the queries', have no neighbours. With near only rows that share a bucket are looked at.

    The corpus is read once. Queries of at most sent_bytes go to every task, which keeps its k best of each; more of
    them meet the corpus in cells of a query tile and a corpus group, in one shuffle of corpus rows x tiles and
    queries x groups. What a cell gives grows with its queries only.
    """
    schema, types = _schema(queries, corpus)
    asked, rows = queries.select("query_id", "embedding", *keys).where("embedding is not null"), corpus.select("chunk_id", "embedding", *keys).where("embedding is not null")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("embedding") * 8 + 64), F.lit(0)).alias("bytes")).first()
    if not size["n"]:
        return corpus.sparkSession.createDataFrame([], schema)
    if size["bytes"] <= sent_bytes:
        shared = corpus.sparkSession.sparkContext.broadcast(asked.toArrow())

        def score(batches):
            table = shared.value
            blocks = [Scorer(table.slice(lo, tile), k, keys, skip_self, near) for lo in range(0, table.num_rows, tile)]
            for b in batches:
                for block in blocks:
                    block.add(b)
            for block in blocks:
                if (out := block.best(types)) is not None:
                    yield out

        return rows.mapInArrow(score, schema)

    tiles = -(-size["n"] // tile)
    groups = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    empty = pa.RecordBatch.from_pylist([], pa.schema([("query_id", types["query_id"]), ("chunk_id", types["chunk_id"]), ("similarity", pa.float64())]))

    def cell(asked: pa.Table, rows: pa.Table) -> pa.Table:
        asked = unpacked(asked)
        if asked is None or "embedding" not in rows.schema.names:
            return pa.Table.from_batches([empty])
        block = Scorer(asked, k, keys, skip_self, near)
        block.add(rows)
        return pa.Table.from_batches([block.best(types) or empty])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Packed, since both sides of a cogroup may come from one table, whose columns they must not share.
    left = asked.select("query_id", F.struct("*").alias("asked")).withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int")).withColumn("group", every(groups)).drop("query_id")
    right = rows.withColumn("group", F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).cast("int")).withColumn("tile", every(tiles))
    return left.groupBy("tile", "group").cogroup(right.groupBy("tile", "group")).applyInArrow(cell, schema)
