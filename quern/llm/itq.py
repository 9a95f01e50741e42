"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations are learnt on a bounded sample (at most ``sample`` vectors, least hash
first): the sample is centred and projected on its principal axes, and an
alternation of signs and an orthogonal Procrustes step turns the axes so that the
signs are balanced binary codes. Several such rotations give a code of T chunks
of k bits. Every vector is posted in T tables, one for each chunk, so that any
two codes that differ in fewer than T bits meet in some table. Within a posting
list the original vectors are compared in blocks by exact cosine in double
precision. A pair is counted in the first table where it meets, so a list gives
counts for each vector and the links of a spanning forest, not its pairs.

The axes keep their scale, so that bits differ by what differs in the vectors. T
follows from the wanted recall, measured with the codes themselves on pairs at
the threshold (closer pairs have more): sampled vectors with noise in all
directions, with noise along the data, and pairs found in the sample; the worst
kind counts. k, at most the logarithm of the number of vectors so that lists
of unrelated vectors stay short, is where T postings and the lists measured on the
sample cost least. Where no chunks reach the recall, all vectors are one list. Lists longer than ``block`` are dealt out as
pairs of blocks; a pair of vectors whose codes agree in the first chunk is compared in the
first table only, so a dense cluster is not compared again in each. Copies of a vector are one entry with a count.

Vectors of different length have no cosine and never link; the most frequent length
and each with more than ``block`` different vectors have codes of their own, the others are
lists of at most that many, compared without codes. Rows are scaled by a power of two before their norm is taken, so
that very small and very large ones neither vanish nor overflow.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, and neither do rows without an id: they keep their own id as component. Ties do not
matter (links are counted, not ranked); rows of one id and vector are copies that link with each other; an
empty table gives an empty result; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, parts, table
from .graph import components


def learn_rotation(x: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Columns that turn centred rows into code bits by their signs."""
    axes = np.linalg.eigh(x.T @ x)[1]
    v = x @ axes
    turn, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
        turn = left @ right
    return axes @ turn


def learn_codes(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection with at least bits columns) from sample rows of unit length."""
    rng, mean, out = np.random.default_rng(seed), x.mean(0), []
    while sum(r.shape[1] for r in out) < bits:
        out.append(learn_rotation(x - mean, rounds, rng))
    return mean, np.concatenate(out, axis=1)[:, :bits]


def max_bits(n: int) -> int:
    """The most bits of a chunk for n vectors."""
    return max(6, min(24, round(math.log2(max(n, 2) / 48))))


def meeting(k: int, threshold: float) -> float:
    """The chance that vectors at the threshold agree in k random bits."""
    return min(1 - 1e-12, max(1e-12, (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** k))


def near_pairs(x: np.ndarray, threshold: float, rng: np.random.Generator, n: int = 3000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of pairs of unit vectors at or near the threshold, made and found from sample rows of unit length."""
    base = x[rng.permutation(len(x))[:n]]
    out = []
    for noise in (rng.normal(size=base.shape), x[rng.integers(len(x), size=len(base))] - x[rng.integers(len(x), size=len(base))]):
        noise = noise - (noise * base).sum(1, keepdims=True) * base
        size = np.sqrt((noise * noise).sum(1, keepdims=True))
        ok = size[:, 0] > 1e-9
        if ok.any():
            out.append((base[ok], threshold * base[ok] + math.sqrt(max(0.0, 1 - threshold**2)) * noise[ok] / size[ok]))
    found = []
    for at in range(0, len(base), 500):
        s = base[at : at + 500] @ x.T
        i, j = np.nonzero((s >= threshold) & (s <= (1 + threshold) / 2))
        found.append(np.stack([i + at, j]))
    i, j = np.concatenate(found, axis=1)
    if len(i) >= 100:
        some = rng.permutation(len(i))[:n]
        out.append((base[i[some]], x[j[some]]))
    return out


def learn_tables(x: np.ndarray, n: int, threshold: float, recall: float, rounds: int = 30, seed: int = 11, most: int = 128, posting: float = 1000.0) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(mean, projection, k, T) from sample rows of unit length, for n vectors; a posting costs as much as comparing that many vectors."""
    rng, mean, columns = np.random.default_rng(seed), x.mean(0), []
    pairs = near_pairs(x, threshold, np.random.default_rng(seed + 1))
    some = x[np.random.default_rng(seed + 2).permutation(len(x))[:5000]]
    equal, bits = [np.zeros((len(a), 0), bool) for a, _ in pairs], np.zeros((len(some), 0), bool)

    def chunk(m: np.ndarray, k: int, t: int) -> np.ndarray:
        return m[:, t * k : (t + 1) * k]

    def tables(k: int) -> int | None:
        nonlocal equal, bits
        met = [np.zeros(len(e), bool) for e in equal]
        for t in range(most):
            while bits.shape[1] < (t + 1) * k:
                r = learn_rotation(x - mean, rounds, rng)
                columns.append(r)
                equal = [np.hstack([e, ((a - mean) @ r >= 0) == ((b - mean) @ r >= 0)]) for e, (a, b) in zip(equal, pairs, strict=True)]
                bits = np.hstack([bits, (some - mean) @ r >= 0])
            met = [m | chunk(e, k, t).all(1) for m, e in zip(met, equal, strict=True)]
            if all(m.mean() >= recall for m in met):
                at_least = max(4, math.ceil(math.log(1 - recall) / math.log(1 - meeting(k, threshold))))
                return max(t + 1, min(most, at_least))
        return None

    def listed(k: int) -> float:
        share = []
        for t in range(4):
            c = np.unique(chunk(bits, k, t) @ (1 << np.arange(k)), return_counts=True)[1].astype(float)
            share.append((c * (c - 1)).sum() / max(len(some) * (len(some) - 1), 1))
        return float(np.mean(share)) * n

    best = None
    for k in range(6, max_bits(n) + 1):
        t = tables(k)
        if t is None or best and t * posting >= best[0]:
            break
        cost = t * (posting + listed(k))
        if best is None or cost < best[0]:
            best = (cost, k, t)
    for k in range(5, 0, -1):
        if best is None and (t := tables(k)):
            best = (0.0, k, t)
    _, k, t = best or (0.0, 0, 1)
    while columns and sum(c.shape[1] for c in columns) < k * t:
        columns.append(learn_rotation(x - mean, rounds, rng))
    return mean, np.hstack([np.zeros((x.shape[1], 0)), *columns])[:, : k * t], k, t


def _as_matrix(column, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; a power of two takes out their size first, so that no square is lost."""
    m = m.astype(np.float64)
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True, initial=0))[1])
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _lists(dim: int, kind: str, k: int, n_tables: int, threshold: float, block: int):
    """Reads rows (t, key, part, a, b, rep, n, code, vec) sorted by (t, key, a, b) and gives (rep, links, other); without dim the key is the length."""

    def compare(t: int, same: bool, left, right, degree: dict, links: list):
        """Pairs of left and right (of one block, if same), but for those whose codes agree in a table before t."""
        if not t:
            return tile(0, same, left, right, degree, links)
        left, right = ([x[o] for x in side] for side in (left, right) for o in [np.argsort(side[2][:, 0], kind="stable")])
        first, begin = np.unique(left[2][:, 0], return_index=True)
        for value, lo, hi in zip(first.tolist(), begin.tolist(), [*begin[1:].tolist(), len(left[0])], strict=True):
            a, b = np.searchsorted(right[2][:, 0], [value, value + 1]).tolist()
            mine = [x[lo:hi] for x in left]
            for rest in ([x[b:] for x in right],) if same else ([x[:a] for x in right], [x[b:] for x in right]):
                if len(rest[0]):
                    tile(t, False, mine, rest, degree, links)

    def tile(t: int, same: bool, left, right, degree: dict, links: list):
        ids_l, n_l, code_l, vec_l = left
        ids_r, n_r, code_r, vec_r = right
        for at in range(0, len(ids_l), 512):
            s = vec_l[at : at + 512] @ vec_r.T >= threshold
            i, j = np.nonzero(s)
            if same:
                i, j = i[i + at < j], j[i + at < j]
            if t:
                new = ~(code_l[i + at, :t] == code_r[j, :t]).any(axis=1)  # else an earlier table has the pair
                i, j = i[new], j[new]
            if not len(i):
                continue
            a, b = ids_l[i + at], ids_r[j]
            for ids, n in ((a, n_r[j]), (b, n_l[i + at])):
                u, inv = np.unique(ids, return_inverse=True)
                for x, y in zip(u.tolist(), np.bincount(inv, weights=n).astype(np.int64).tolist(), strict=True):
                    degree[x] = degree.get(x, 0) + y
            links.append(forest(a, b))

    def run(batches):
        held: list = []
        held_key = None

        def flush():
            rows = [np.concatenate([h[c] for h in held]) for c in range(5)]
            part, ids, n, code, vec = rows
            t, a, b = held_key[0], held_key[2], held_key[3]
            degree: dict = {}
            links: list = []
            side = lambda m: (ids[m], n[m], code[m], vec[m])
            if a == b:
                if len(ids) > 1:
                    compare(t, True, side(slice(None)), side(slice(None)), degree, links)
            elif (part == a).any() and (part == b).any():
                compare(t, False, side(part == a), side(part == b), degree, links)
            return degree, links

        def out(degree, links):
            pairs = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
            rep = np.concatenate([np.array(list(degree), np.int64), pairs[0]])
            n = np.concatenate([np.array(list(degree.values()), np.int64), np.zeros(pairs.shape[1], np.int64)])
            other = pa.array(np.concatenate([np.full(len(degree), -1), pairs[1]]).astype(np.int64), mask=np.concatenate([np.ones(len(degree), bool), np.zeros(pairs.shape[1], bool)]))
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n), other], ["rep", "links", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("t", "key", "a", "b")]
            cols = [batch.column(c).to_numpy() for c in ("part", "rep", "n")]
            codes, vecs = batch.column("code"), batch.column("vec")
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in keys], axis=0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                key = tuple(int(x[lo]) for x in keys)
                if held_key is not None and key != held_key:
                    degree, links = flush()
                    if degree:
                        yield out(degree, links)
                    held = []
                held_key = key
                code = np.frombuffer(b"".join(codes.slice(lo, hi - lo).to_pylist()), "<i4").reshape(hi - lo, n_tables)
                vec = _unit(_as_matrix(vecs.slice(lo, hi - lo), dim or key[1], kind))
                held.append((cols[0][lo:hi], cols[1][lo:hi], cols[2][lo:hi], code, vec))
        if held:
            degree, links = flush()
            if degree:
                yield out(degree, links)

    return run


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs of a spanning forest of the given pairs, as two rows."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return np.array(out, np.int64).reshape(-1, 2).T


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, recall: float = 0.99, sample: int = 20_000, block: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "itq")
    kind, width = ("<f4", 4) if dict(df.dtypes)[vec_col] == "array<float>" else ("<f8", 8)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))

    def to_bytes(batch: pa.RecordBatch):
        out = []
        for v in batch.column("v").to_pylist():
            ok = v is not None and len(v) > 0 and None not in v
            m = np.array(v, kind) if ok else None
            out.append((m + m.dtype.type(0)).tobytes() if ok and np.isfinite(m).all() and (m != 0).any() else None)  # + 0: one zero only
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "vec"])

    made = scratch.write(map_batches(rows, to_bytes, "vec_id long, vec binary"))
    usable = made.where("vec is not null and vec_id is not null")
    distinct = scratch.write(usable.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    sizes = distinct.groupBy(F.length("vec").alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l")
    many = [(r["l"] // width, r["n"]) for r in sizes.limit(1).unionByName(sizes.where(F.col("n") > block)).distinct().collect()]  # at most rows / block lengths
    found = [_linked_by_codes(distinct.where(F.length("vec") == dim * width), dim, total, kind, threshold, recall, sample, block, scratch) for dim, total in many]
    few = distinct.where(~F.length("vec").isin([dim * width for dim, _ in many])) if many else distinct
    one_list = few.select(F.lit(0).alias("t"), (F.length("vec") / width).cast("long").alias("key"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("part"), "rep", "n", F.lit(b"").alias("code"), "vec")
    by_length = one_list.repartition(parts(spark), "key").sortWithinPartitions("key").mapInArrow(_lists(None, kind, 0, 0, threshold, block), FOUND)
    found = scratch.write(reduce(DataFrame.unionByName, found, by_length))
    degree = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch)
    joined = scratch.write(distinct.join(degree, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("vec", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "rep").alias("label")))
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "label").select("vec", "n_links", "component_id")
    linked = usable.join(named, "vec").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = made.where(F.col("vec").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


FOUND = "rep long, links long, other long"


def _linked_by_codes(distinct: DataFrame, dim: int, total: int, kind: str, threshold: float, recall: float, sample: int, block: int, scratch: Scratch) -> DataFrame:
    """Counts and links of different vectors of one length, total of them, through Hamming tables learnt on them."""
    spark = distinct.sparkSession

    def learn(batches):
        x = _unit(np.concatenate([_as_matrix(b.column("vec"), dim, kind) for b in batches if b.num_rows] or [np.eye(dim, dtype=kind)]))
        mean, projection, k, n_tables = learn_tables(x[np.lexsort(x.T[:3])], total, threshold, recall)
        yield pa.RecordBatch.from_pydict({"m": [np.vstack([mean, projection.T]).astype("<f8").tobytes()], "k": [k], "t": [n_tables]})

    chosen = distinct.orderBy(F.xxhash64("vec"), "rep").limit(min(sample, max(1000, 8_000_000 // dim))).select("vec")
    learnt = chosen.repartition(1).mapInArrow(learn, "m binary, k long, t long").collect()[0]
    model, k, n_tables = np.frombuffer(learnt["m"], "<f8").reshape(-1, dim), learnt["k"], learnt["t"]
    shared = spark.sparkContext.broadcast(model)
    weights = 1 << np.arange(k, dtype=np.int64)

    def post(batch: pa.RecordBatch):
        x = _unit(_as_matrix(batch.column("vec"), dim, kind))
        bits = (x - shared.value[0]) @ shared.value[1:].T >= 0
        code = (bits.reshape(len(x), n_tables, k) * weights).sum(2)
        rep, n = batch.column("rep"), batch.column("n")
        packed = pa.array([c.tobytes() for c in code.astype("<i4")], pa.binary())
        for t in range(n_tables):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code[:, t]), rep, n, packed, batch.column("vec")], ["t", "key", "rep", "n", "code", "vec"])

    posted = map_batches(distinct, post, "t int, key long, rep long, n long, code binary, vec binary")
    sizes = map_batches(distinct, lambda b: (x.select(["t", "key"]) for x in post(b)), "t int, key long").groupBy("t", "key").agg(F.count("*").alias("size")).where(F.col("size") > block)
    sizes = scratch.write(sizes.select("t", "key", F.ceil(F.col("size") / block).cast("int").alias("cuts")))
    if sizes.isEmpty():
        dealt = posted.withColumns({"part": F.lit(0), "a": F.lit(0), "b": F.lit(0)})
    else:  # a long list is cut by hash, and each part meets each part in a group of its own
        cut = posted.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, ["t", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        cut = cut.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        dealt = cut.withColumns({"a": F.least("part", "o"), "b": F.greatest("part", "o")})
    keys = ["t", "key", "a", "b"]
    lists = dealt.select(*keys, "part", "rep", "n", "code", "vec").repartition(parts(spark), *keys).sortWithinPartitions(*keys)
    return lists.mapInArrow(_lists(dim, kind, k, n_tables, threshold, block), FOUND)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: links and components of every embedding."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
