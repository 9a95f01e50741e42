"""Texts as codes of the distinct words of their batch.

Most words of a batch of texts recur in it, so what has to meet the same word of other
batches is the batch's list of distinct words, not every occurrence. A batch is one row: its documents as
arrays of codes, and its words with how often they occur. Codes count from 1 in
order of first occurrence; 0 is a break that no word is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "batch long, ids array<long>, codes array<array<int>>, words array<string>, tags array<string>, counts array<long>"
BREAK = b"."


class _Codes(dict):
    """Codes of the words of one tag; what it has not seen gets the batch's next code.

    It knows the batch's lists and not the batch: a circle of references would keep each batch until Python looks for circles.
    """

    def __init__(self, words: list, tags: list, tag: str | None):
        super().__init__({BREAK: 0})
        self.words, self.tags, self.tag = words, tags, tag

    def __missing__(self, word):
        self.words.append(word)
        self.tags.append(self.tag)
        code = self[word] = len(self.words)
        return code


class _Batch:
    def __init__(self):
        self.words, self.tags, self.ids, self.codes, self.by_tag, self.size = [], [], [], [], {}, 0

    def add(self, doc_id: int | None, tag: str | None, words: Sequence, size: int) -> None:
        codes = self.by_tag.get(tag)
        if codes is None:
            codes = self.by_tag[tag] = _Codes(self.words, self.tags, tag)
        self.ids.append(doc_id)
        self.codes.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
        self.size += size + 64

    def row(self, batch: int) -> pa.RecordBatch:
        flat = np.concatenate(self.codes)
        ends = np.cumsum([0, *map(len, self.codes)])
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [
            pa.array([batch], pa.int64()),
            one(pa.array(self.ids, pa.int64())),
            one(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))),
            one(pa.array(self.words, pa.string())),
            one(pa.array(self.tags, pa.string())),
            one(pa.array(np.bincount(flat, minlength=len(self.words) + 1)[1:], pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["batch", "ids", "codes", "words", "tags", "counts"])


def code_batches(docs: DataFrame, split: Callable[[str], Sequence], tag: str | None = None, most_bytes: int = 8 << 20) -> DataFrame:
    """One row a batch of about most_bytes of texts (one text at least, whatever its length).

    split(text) gives a text's words, of one type throughout; BREAK, where it occurs, becomes 0. Words are told apart by
    the column ``tag``. Batch numbers follow the task, so write the result before it is read more than once.
    """
    size = F.octet_length("text").cast("long") if "text" in docs.columns else F.lit(0).cast("long")
    given = docs.select(F.col("doc_id").cast("long"), F.col("text"), (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag"), size.alias("size"))

    def run(batches):
        part, n, now = TaskContext.get().partitionId(), 0, _Batch()
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # few texts at a time as Python strings
                some = b.slice(lo, 256)
                for doc_id, text, t, k in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "tag", "size")), strict=True):
                    now.add(doc_id, t, split(text or ""), k or 0)
                    if now.size >= most_bytes:
                        yield now.row(part << 32 | n)
                        n, now = n + 1, _Batch()
        if now.ids:
            yield now.row(part << 32 | n)

    return given.mapInArrow(run, SCHEMA)


def batch_words(coded: DataFrame) -> DataFrame:
    """(batch, code, tag, word, n): a row for each distinct word of each batch."""
    each = F.posexplode(F.arrays_zip("words", "tags", "counts"))
    return coded.select("batch", each.alias("at", "w")).select("batch", (F.col("at") + 1).alias("code"), F.col("w.tags").alias("tag"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
