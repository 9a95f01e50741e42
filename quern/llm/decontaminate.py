"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

An item and a document are sequences of words (runs of letters, digits and
underscores, lower-cased). A document leaks an item if some window of as many
words as the item has (the whole document if it is shorter) reaches a weighted
similarity of ``least`` over five-word shingles: the sum of the smaller counts
over the sum of the larger. An item of fewer than five words is one shingle of
its own length.

Every item has a fingerprint of BITS bits, the SimHash of its shingles, where the
second occurrence of a shingle is a feature of its own, and so on; so similar
counts are always similar sets. A window of a document gets one for each length of
items, unless too few of its shingles occur in any item at all for the wanted similarity to any
(a necessary condition that names no item). The fingerprints of a length's items
lie in a multi-index of Hamming tables: BITS / 16 blocks of 16 bits, each item posted under
all values within ``radius`` // blocks bits of its own, so that looking up a
window's blocks gives every item within ``radius`` (of unrelated items a sixth
meet, and the whole fingerprint leaves none of these). Each window and
item found is verified exactly. At a similarity of 0.8 a fingerprint differs in 39 bits of 256 with
a deviation of 6, so that one in 100,000 lies beyond 63.

Items are read in blocks of ``block`` items whose index is broadcast, so its size
has a bound; documents are scanned once a block, whole, in slices of bounded size, and never shuffled.

Null or empty documents and items without words match nothing; repeated rows
give a result each; ties between windows go to the first; texts may have any
length; empty tables give an empty result; other columns are left aside (kept by
drop_leaks), whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table

WORDS = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)
SHINGLE, BITS = 5, 256
SALTS = [np.uint64(0x2545F4914F6CDD1D * (2 * k + 1) & (2**64 - 1)) for k in range(BITS // 64)]


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code of every run of k word numbers."""
    out = np.zeros(max(len(ids) - k + 1, 0), np.uint64)
    for j in range(k):
        out = _mix(out * MIX + ids[j : j + len(out)].astype(np.uint64) + np.uint64(1))
    return out


def _feature_bits(features: np.ndarray) -> np.ndarray:
    """BITS bits of each 64-bit feature."""
    words = np.stack([_mix(features ^ salt) for salt in SALTS], axis=1)
    return np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(features), -1), axis=1)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of shingle codes, each occurrence a feature of its own, as rows of 16-bit blocks."""
    order = np.argsort(shingles, kind="stable")
    x = shingles[order]
    first = np.concatenate([[True], x[1:] != x[:-1]])
    at = np.arange(len(x))
    occurrence = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return _signs(_feature_bits(x + occurrence * MIX).sum(axis=0, dtype=np.int64)[None], np.array([len(x)]))[0]


def _signs(ones: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.packbits(2 * ones > size[:, None], axis=1).view(">u2").astype(np.uint16)


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """fingerprint() of every window, by differences of running sums; windows in ascending order of start."""
    order = np.argsort(shingles, kind="stable")
    before = np.full(len(shingles), -1, np.int64)  # the last place of the same shingle
    same = shingles[order][1:] == shingles[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    latest = np.maximum.accumulate(before) if len(before) else before
    out = np.zeros((len(starts), BITS // 16), np.uint16)
    lo = 0
    while lo < len(starts):
        hi = min(int(np.searchsorted(starts, starts[lo] + most)), lo + most)
        base, end = int(starts[lo]), int((starts[lo:hi] + sizes[lo:hi]).max())
        sums = np.zeros((end - base + 1, BITS), np.int32)
        np.cumsum(_feature_bits(shingles[base:end]), axis=0, dtype=np.int32, out=sums[1:])
        s, n = starts[lo:hi] - base, sizes[lo:hi]
        out[lo:hi] = _signs(sums[s + n] - sums[s], n)
        lo = hi
    for w in np.flatnonzero(latest[starts + sizes - 1] >= starts).tolist():  # a shingle occurs twice
        out[w] = fingerprint(shingles[starts[w] : starts[w] + sizes[w]])
    return out


def neighbours(bits: int) -> np.ndarray:
    """The 16-bit words with at most so many ones."""
    x = np.arange(1 << 16, dtype=np.uint16)
    return x[np.bitwise_count(x) <= bits]


class HammingIndex:
    """Tables of 16-bit blocks: each fingerprint is posted under all values near its block, so that one look-up a block finds all within the radius."""

    def __init__(self, prints: np.ndarray, radius: int):
        blocks = prints.shape[1]
        self.prints, self.radius = prints, radius
        near = neighbours(radius // blocks)
        self.tables = []
        for b in range(blocks):
            keys = (prints[:, b, None] ^ near[None]).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], (order // len(near)).astype(np.int32)))

    def meet(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, fingerprint number) of every pair that meets in a table, once each."""
        found = []
        for b, (keys, owner) in enumerate(self.tables):
            lo = np.searchsorted(keys, queries[:, b])
            n = np.searchsorted(keys, queries[:, b], side="right") - lo
            q = np.repeat(np.arange(len(queries)), n)
            found.append(q * len(self.prints) + owner[np.repeat(lo, n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def search(self, queries: np.ndarray, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """(query number, fingerprint number) of every pair within the radius."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo in range(0, len(queries), most):
            q, p = self.meet(queries[lo : lo + most])
            ok = np.bitwise_count(queries[lo + q] ^ self.prints[p]).sum(axis=1, dtype=np.int64) <= self.radius
            found.append((lo + q[ok], p[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class ItemIndex:
    """The items of one block: vocabulary, known shingles, and a Hamming index for each length."""

    def __init__(self, items: list[tuple[int, str]], least: float, radius: int):
        self.least = least
        texts = [(i, w) for i, t in items if (w := words(t))]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.ids = np.array([i for i, _ in texts], np.int64)
        n_words = np.array([len(w) for _, w in texts], np.int64)
        shingles = [codes(np.array([self.vocabulary[x] for x in w], np.int64), min(len(w), SHINGLE)) for _, w in texts]
        self.counts = [Counter(s.tolist()) for s in shingles]
        prints = np.array([fingerprint(s) for s in shingles]).reshape(len(shingles), BITS // 16)
        self.known: dict[int, np.ndarray] = {}
        self.lengths: dict[int, dict[int, tuple[np.ndarray, HammingIndex]]] = {}  # by words a shingle, then by words
        for k in np.unique(np.minimum(n_words, SHINGLE)).tolist():
            mine = np.minimum(n_words, SHINGLE) == k
            self.known[k] = np.unique(np.concatenate([shingles[j] for j in np.flatnonzero(mine)]))
            self.lengths[k] = {int(n): (at := np.flatnonzero(n_words == n), HammingIndex(prints[at], radius)) for n in np.unique(n_words[mine])}

    def find(self, texts: list[str | None]) -> list[tuple[int, int, float, int]]:
        """(text number, item id, similarity, first word) of the best window of every leaked item."""
        get, parts, ends, at = self.vocabulary.get, [], [], 0
        for t in texts:
            w = words(t)
            parts.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
            at += len(w)
            ends.append(at)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends_a = np.array(ends, np.int64)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for k, lengths in self.lengths.items():
            held, own = [], {}
            for d, marks in self._known(ids, ends_a, k):
                begin = ends[d - 1] if d else 0
                shingles = codes(ids[begin : ends[d]], k)
                found = self._windows(shingles, marks - begin, k)
                if found:
                    own[d] = shingles
                    held.append((np.full(len(found[0]), d), *found))
            if not held:
                continue
            doc, starts, sizes, n_words, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            for n in np.unique(n_words).tolist():
                mine = np.flatnonzero(n_words == n)
                members, index = lengths[n]
                q, p = index.search(prints[mine])
                for d, s, w, j in zip(doc[mine[q]].tolist(), starts[mine[q]].tolist(), sizes[mine[q]].tolist(), members[p].tolist(), strict=True):
                    sim = self._similarity(own[d][s : s + w], j)
                    if sim >= self.least - 1e-9 and (sim, -s) > best.get((d, j), (0.0, 0)):
                        best[d, j] = (sim, -s)
        return [(d, int(self.ids[j]), sim, -s) for (d, j), (sim, s) in sorted(best.items())]

    def _known(self, ids: np.ndarray, ends: np.ndarray, k: int):
        """(text, places of shingles that some item has) of the texts with any."""
        if len(ids) < k:
            return
        whole = np.ones(len(ids) - k + 1, bool)
        for j in range(k):
            whole &= ids[j : j + len(whole)] > 0
        where = np.flatnonzero(whole)
        doc = np.searchsorted(ends, where, side="right")
        inside = where + k <= ends[doc]
        where, doc = where[inside], doc[inside]
        hit = np.isin(codes_at(ids, where, k), self.known[k])
        where, doc = where[hit], doc[hit]
        cuts = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(doc[lo]), where[lo:hi]

    def _windows(self, shingles: np.ndarray, marks: np.ndarray, k: int) -> tuple[np.ndarray, ...] | None:
        """(first shingle, shingles, words of the item's length, fingerprint) of the windows that may reach the similarity to any item."""
        flags = np.zeros(len(shingles) + 1, np.int64)
        flags[marks + 1] = 1
        sums = np.cumsum(flags)
        found = []
        for n in self.lengths[k]:
            size = n - k + 1
            w = min(size, len(shingles))
            need = self.least * (w + size) / (1 + self.least)  # what a window must share with an item of that size
            if len(marks) < need - 1e-9:
                continue
            s = np.flatnonzero(sums[w:] - sums[: len(sums) - w] >= need - 1e-9)
            found.append(np.stack([s, np.full(len(s), w), np.full(len(s), n)]))
        if not sum(x.shape[1] for x in found):
            return None
        starts, sizes, n_words = np.concatenate(found, axis=1)
        order = np.lexsort((sizes, starts))
        starts, sizes, n_words = starts[order], sizes[order], n_words[order]
        # Only what some window covers gets features; windows stay in one piece there.
        cover = np.zeros(len(shingles) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + sizes, -1)
        covered = np.cumsum(cover[:-1]) > 0
        place = np.cumsum(covered) - 1
        return starts, sizes, n_words, window_fingerprints(shingles[covered], place[starts], sizes)

    def _similarity(self, window: np.ndarray, j: int) -> float:
        shared = sum(min(v, self.counts[j].get(x, 0)) for x, v in Counter(window.tolist()).items())
        return shared / (len(window) + self.counts[j].total() - shared)


def codes_at(ids: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(where), np.uint64)
    for j in range(k):
        out = _mix(out * MIX + ids[where + j].astype(np.uint64) + np.uint64(1))
    return out


_INDEXES: dict[str, ItemIndex] = {}


def _index(shared, least: float, radius: int) -> ItemIndex:
    """The process's index of a broadcast block of items: a Python worker keeps the last one from task to task."""
    key, items = shared.value
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = ItemIndex(items, least, radius)
    return _INDEXES[key]


def _blocks(items: DataFrame, id_col: str, text_col: str, block: int):
    """Broadcasts of at most block items each, named; the driver holds one block of items at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator()
    while part := [(r["i"], r["t"]) for r in islice(rows, block)]:
        part = [(i, t) for i, t in part if WORDS.search(t)]
        if part:
            yield items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part))


def _scan(texts: list[str | None], index: ItemIndex, most: int = 4_000_000):
    """index.find over slices of the texts of bounded size."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most or k + 1 == len(texts):
            for d, *rest in index.find(texts[at : k + 1]):
                yield (at + d, *rest)
            at, size = k + 1, 0


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8, radius: int = 63, block: int = 1000) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) for every item that a row of df leaks."""
    schema = "doc_id long, item_id long, similarity double, first_word long"
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scan(shared):
        def run(batch: pa.RecordBatch, index: ItemIndex):
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[d], *rest) for d, *rest in _scan(batch.column("text").to_pylist(), index)]
            return pa.RecordBatch.from_pydict(dict(zip(("doc_id", "item_id", "similarity", "first_word"), zip(*found, strict=True), strict=True))) if found else None

        return map_batches(rows, run, schema, lambda: _index(shared, least, radius))

    found = [scan(s) for s in _blocks(items, item_id, item_text, block)]
    return reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], schema)


def drop_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8, radius: int = 63, block: int = 1000) -> DataFrame:
    """df without the rows that leak an item; all columns stay."""
    for shared in _blocks(items, item_id, item_text, block):

        def run(batch: pa.RecordBatch, index: ItemIndex):
            bad = {d for d, *_ in _scan(batch.column(text_col).to_pylist(), index)}
            return batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

        df = map_batches(df, run, df.schema, lambda shared=shared: _index(shared, least, radius))
    return df


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every benchmark item that a document leaks."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
