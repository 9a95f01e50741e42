"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 64 bits, eight bytes. Two fingerprints within three bits
differ in at most three bytes, so at least five of their positional bytes
agree; of the two halves of four bytes, one then has three that agree. The posting
list of one positional byte would hold a 256th of all fingerprints, so the index
is dealt by the eight positional byte triples (four in each half): every
distinct fingerprint goes to each of its triples, and no pair within the distance is
missed. There the members are posted under their other positional bytes, the
lists a fingerprint is in are tallied, those that share fewer than
the guaranteed five bytes with it are dropped, and the rest are verified by Hamming distance.

A triple with more than ``hot`` members is dealt anew by two further positional
bytes (at least two of the other five agree). Where a list's members agree in five
bytes or more, half bytes are posted and tallied instead (at least thirteen of
sixteen agree), so that only lists of half bytes are read there too. A list
gives the links of a spanning forest instead of all its pairs. Copies share a
fingerprint and are one entry of the index.

Null or empty texts have fingerprint zero and link like any other; a text may have
any length (its shingles are counted in blocks); ties do not occur, as a bit is
set by more than half; repeated rows and equal ids keep their rows; rows without
an id get a component, and name none where another has one; an empty table gives
an empty result; other columns are left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, parts, table, words_of
from .graph import components

TRIPLES = tuple(t for half in (range(4), range(4, 8)) for t in combinations(half, 3))
BLOCK = 1 << 16


def fingerprint(words: list[bytes], n: int = 3) -> int:
    """The SimHash of a word sequence over n-word shingles, repeats included."""
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(joined, 42)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    a, b = starts[: -n - 1 + 1][: len(words) - n + 1].tolist(), (starts[n:] - 1).tolist()
    ones, total = np.zeros(64, np.int64), len(a)
    for k in range(0, total, BLOCK):
        h = np.array([digest(joined[x:y], 42) for x, y in zip(a[k : k + BLOCK], b[k : k + BLOCK], strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint of every row, its 64 bits as a signed long."""

    def run(batch: pa.RecordBatch):
        fp = np.array([fingerprint(words_of(t)) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _byte(fp, i: int):
    return F.shiftrightunsigned(fp, 8 * (7 - i)).bitwiseAND(F.lit(255))


def _posting(fp, positions: tuple[int, ...], tag: int):
    key = F.lit(tag).cast("long")
    for i in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, i))
    return key


class Postings:
    """The members of a list under their positional bytes, or half bytes where the bytes guarantee nothing."""

    def __init__(self, fps: np.ndarray, radius: int):
        units = fps.view(np.uint8).reshape(-1, 8)
        self.units, self.need = self._varying(units, radius)
        if self.need <= 0:
            self.units, self.need = self._varying(np.concatenate([units >> 4, units & 15], axis=1), radius)
        self.lists = []
        for column in self.units.T:
            order = np.argsort(column, kind="stable")
            self.lists.append((order, np.searchsorted(column[order], np.arange(257))))

    @staticmethod
    def _varying(units: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """The units in which members differ, and how many of them two members within the radius share at least."""
        differ = (units != units[0]).any(axis=0)
        return units[:, differ], int(differ.sum()) - radius

    def candidates(self, k: int) -> np.ndarray:
        """The members that share the guaranteed number of units with member k, by a tally over its lists."""
        if self.need <= 0:  # at most radius half bytes differ at all
            return np.arange(len(self.units))
        found = [order[cuts[u] : cuts[u + 1]] for (order, cuts), u in zip(self.lists, self.units[k].tolist(), strict=True)]
        members, tally = np.unique(np.concatenate(found), return_counts=True)
        return members[tally >= self.need]


def _links(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of a spanning forest of one list of distinct fingerprints: every linked pair is joined by a path of them."""
    n = len(fps)
    if n == 2:  # most lists; the tally of two is what agrees
        x = fps[0] ^ fps[1]
        if int(x).bit_count() <= radius:
            yield fps[:1], fps[1:]
        return
    index, seen, todo = Postings(fps, radius), np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        todo.append(root)
        while todo:
            at = todo.pop()
            rest = index.candidates(at)
            rest = rest[~seen[rest]]
            rest = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= radius]
            if len(rest):
                seen[rest] = True
                todo.extend(rest.tolist())
                yield np.full(len(rest), fps[at]), fps[rest]


def _search(radius: int):
    """Reads rows (key, fp) sorted by key and gives links; a posting list may lie over several Arrow batches."""

    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def lists(keys, fps, last: bool):
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            a, b = [], []
            for i in np.flatnonzero(ends - starts > 1):
                for x, y in _links(np.ascontiguousarray(fps[starts[i] : ends[i]]).view(np.uint64), radius):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([held_k, batch.column(0).to_numpy()])
            fps = np.concatenate([held_f, batch.column(1).to_numpy()])
            yield from lists(keys, fps, False)
            at = np.searchsorted(keys, keys[-1])
            held_k, held_f = keys[at:].copy(), fps[at:].copy()
        if len(held_k):
            yield from lists(held_k, held_f, True)

    return run


def fingerprint_links(distinct: DataFrame, scratch: Scratch, radius: int = 3, hot: int = 2048) -> DataFrame:
    """(a, b): links that join all of the distinct fingerprints (fp long) that lie within radius (at most 3) bits."""
    fp, n = F.col("fp"), parts(distinct.sparkSession)
    posted = distinct.select("fp", F.explode(F.array(*(F.struct(_posting(fp, t, i).alias("key"), F.lit(i).alias("t")) for i, t in enumerate(TRIPLES)))).alias("p")).select("p.key", "p.t", "fp")
    heavy = scratch.write(posted.groupBy("key").count().where(F.col("count") > hot).select("key"))
    again = posted.join(heavy, "key", "left_semi")

    def finer(i: int) -> F.Column:
        rest = [p for p in range(8) if p not in TRIPLES[i]]
        return F.array(*(_posting(fp, (*TRIPLES[i], *two), 8 + 10 * i + k) for k, two in enumerate(combinations(rest, 2))))

    fine = again.select("fp", F.explode(F.coalesce(*(F.when(F.col("t") == i, finer(i)) for i in range(8)))).alias("key"))
    light = posted.join(heavy, "key", "left_anti").select("key", "fp")
    search = lambda x: x.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_search(radius), "a long, b long")
    found = search(light)
    return found if heavy.isEmpty() else found.unionByName(search(fine.select("key", "fp")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links of at most radius bits."""
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.write(fingerprints(df, id_col, text_col))
    distinct = scratch.write(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(scratch.write(fingerprint_links(distinct.select("fp"), scratch, radius)), scratch)
    joined = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    joined = scratch.write(joined)
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "label").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that are near-duplicates of a row with a smaller id; of rows with an equal id and text one stays.

    Rows without an id take no part and stay.
    """
    known = df.where(F.col(id_col).isNotNull())
    scratch = Scratch(df.sparkSession, "simhash-first")
    found = scratch.write(near_duplicates(known, id_col, text_col))
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col))
    twice = scratch.write(first.groupBy(id_col).count().where("count > 1").select(id_col))
    if twice.isEmpty():
        kept = known.join(first, id_col, "left_semi")
    else:
        kept = known.join(first, id_col, "left_semi")
        kept = kept.join(twice, id_col, "left_anti").unionByName(kept.join(twice, id_col, "left_semi").dropDuplicates([id_col, text_col]))
    return kept.select(df.columns).unionByName(df.where(F.col(id_col).isNull()))
