"""Cross-tokenizer alignment: token groups between common cuts, overlap links, and how often id pairs are linked.

Both tokenizers cut before a space that stands alone between two visible characters (A by its pattern, B because none
of its pieces has a space after another character; ``Pair`` checks both), and neither side of such a cut changes the
tokens of the other. So a text's tokens are those of its stretches between such spaces, and a stretch is aligned once
however often it occurs:

1. Texts become batches of codes of their stretches (batches.py); distinct stretches are encoded by both tokenizers.
2. Relational, by stretch: posexplode tokens, windowed cumulative byte lengths, equi-join on stretch and end, running
   cut counts as group ids. Links are the range join of the two token sequences, taken in one ordered pass: going
   down the ends, each end carries the next token of either side, which are the two tokens that cover the
   bytes before it. So a group without inner cut costs its tokens, not the product of its sides.
3. Pair counts: links weighted by the occurrences of their stretches; each pair is looked up for each distinct stretch.
4. The stretches' numbers and group strings go back to the batches that hold them; a document's are sums and a join
   of strings in order.

A text without such a space is one stretch, so any text is aligned whole. Null and empty texts, and texts that B does
not write back byte by byte, have no tokens: zeros and an empty string. Rows are told apart by their place, so null
and repeated doc_ids give a row each; other columns are left aside. Empty table: no rows.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import batch_words, code_batches
from .common import Scratch, map_batches, parts, table
from .tokens import BYTE_LETTERS, CUT, Encoder, default_path

#: What is not a visible character: controls, spaces and format characters of any kind.
_UNSEEN = r"\x00-\x20\x7f-\xa0\xad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
BETWEEN = re.compile(f"(?<=[^{_UNSEEN}]) (?=[^{_UNSEEN}])")
#: A space that may not part stretches.
_ODD = re.compile(f"^ | \\Z|[{_UNSEEN}] | [{_UNSEEN}]")
#: Most rows of the pair table that are sent to every task (about 64 MB); a larger one is joined by shuffling.
PAIRS_SENT = 1_000_000


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def stretches(text: str) -> list[str]:
    """The text between lone spaces, which are left out."""
    if not text:
        return []
    return BETWEEN.split(text) if _ODD.search(text) else text.split(" ")


class Pair:
    """Both tokenizers, with the byte lengths of their tokens."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        import sentencepiece

        path_a, path_b = path_a or default_path(), path_b or piece_path()
        self.words = Encoder(path_a, 50_000)
        self.path_a = path_a
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: b for b, c in BYTE_LETTERS.items()}
        self.bytes_a = {k: bytes(letters[c] for c in t) for t, k in self.words.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        pieces = [self.b.id_to_piece(k).replace("▁", " ") for k in range(self.b.get_piece_size()) if not self.b.is_control(k)]
        if not self.words.by_cuts or any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("these tokenizers do not both cut before a lone space")

    @functools.cached_property
    def whole(self):
        """The tokenizer of A for which the strings of special tokens are plain text."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path_a)
        whole.encode_special_tokens = True
        return whole

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        if self.b.is_byte(k):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    @functools.cached_property
    def by_ranks(self):
        """tiktoken's merger for A, which is the quicker one for words, if merging in order of ids is what A does; else None."""
        import tiktoken

        file = json.loads(self.words.tokenizer.to_str())
        vocab = file["model"]["vocab"]
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in file["model"]["merges"]]
        letters = sorted(k for t, k in vocab.items() if len(t) == 1)
        plain = {b: k for k, b in self.bytes_a.items()}
        if made != sorted(made) or len(letters) != 256 or [*letters, *made] != sorted(plain.values()):
            return None
        return tiktoken.Encoding("a", pat_str=CUT.pattern, mergeable_ranks=plain, special_tokens={})

    def encode_a(self, words: list[str]) -> list[list[int]]:
        """Ids of a space and the word."""
        given = [" " + w for w in words]
        if self.by_ranks is None:
            return [e.ids for e in self.whole.encode_batch(given, add_special_tokens=False)]
        short, encode = 200, self.by_ranks.encode_ordinary
        return [encode(t) if len(t) < short else self.whole.encode(t, add_special_tokens=False).ids for t in given]

    def encode_b(self, words: list[str]) -> list[list[int]]:
        return self.b.encode(words, num_threads=1)

    def written_back(self, text: str) -> bool:
        """Whether the tokens of both spell a space and the text."""
        want = b" " + text.encode()
        if b"".join(map(self.bytes_b.__getitem__, self.encode_b([text])[0])) != want:
            return False
        return b"".join(map(self.bytes_a.__getitem__, self.encode_a([text])[0])) == want


_PAIRS: dict[tuple, Pair] = {}


def pair(*paths: str | None) -> Pair:
    if paths not in _PAIRS:
        _PAIRS[paths] = Pair(*paths)
    return _PAIRS[paths]


#: Texts of these characters only need no try: letters, marks and signs of plain Latin text, which B keeps as they are.
_SAFE = re.compile(r"[\t\n\r -~\xa0-\u024f\u2010-\u2026\u20ac]*")


def _splitter(paths: tuple):
    def split(text: str) -> list[str]:
        return stretches(text) if _SAFE.fullmatch(text) or pair(*paths).written_back(text) else []

    return split


def _encode(words: DataFrame, paths: tuple) -> DataFrame:
    """(word, n) with the token ids of both tokenizers and their byte lengths."""
    ints = pa.list_(pa.int32())

    def run(b: pa.RecordBatch, both: Pair) -> pa.RecordBatch:
        given = b.column("word").to_pylist()
        columns = list(b.columns)
        for ids, spelt in ((both.encode_a(given), both.bytes_a), (both.encode_b(given), both.bytes_b)):
            columns += [pa.array(ids, ints), pa.array([[len(spelt[i]) for i in x] for x in ids], ints)]
        return pa.RecordBatch.from_arrays(columns, ["word", "n", "a", "a_len", "b", "b_len"])

    return map_batches(words, run, "word string, n long, a array<int>, a_len array<int>, b array<int>, b_len array<int>", lambda: pair(*paths))


def _ends(words: DataFrame, side: str) -> DataFrame:
    """(word_id, end, id): a row a token, with the byte where it ends."""
    tokens = words.select("word_id", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_len").alias("len"))).alias("pos", "t"))
    so_far = Window.partitionBy("word_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.select("word_id", F.sum("t.len").over(so_far).alias("end"), F.col("t.id").alias(side))


def align_words(words: DataFrame) -> DataFrame:
    """(word, n, n_a, n_b, n_groups, links, groups) of rows (word_id, word, n, a, a_len, b, b_len).

    links: the linked id pairs as a * 2^32 + b; groups: ``a1,a2|b1;`` for each group in order.
    """
    ends = _ends(words, "a").join(_ends(words, "b"), ["word_id", "end"], "full")
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    down = Window.partitionBy("word_id").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ends.select(
        "word_id", "end", "a", "b", cut.alias("cut"),
        (-F.sum(cut.cast("int")).over(down)).alias("group"),
        (F.shiftleft(F.last("a", True).over(down).cast("long"), 32) + F.last("b", True).over(down)).alias("link"),
    )

    def fragments(side: str, place: int, at_cut: str):
        text = F.concat(F.col(side).cast("string"), F.when(F.col("cut"), at_cut).otherwise(","))
        return F.collect_list(F.when(F.col(side).isNotNull(), F.struct("group", F.lit(place).alias("side"), "end", text.alias("text"))))

    out = rows.groupBy("word_id").agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if("cut").alias("n_groups"), F.collect_list("link").alias("links"),
        fragments("a", 0, "|").alias("fa"), fragments("b", 1, ";").alias("fb"),
    )
    text = F.array_join(F.transform(F.sort_array(F.concat("fa", "fb")), lambda x: x["text"]), "")
    out = out.select("word_id", "n_a", "n_b", "n_groups", "links", text.alias("groups"))
    return words.select("word_id", "word", "n").join(out, "word_id").drop("word_id")


def _with_counts(scratch: Scratch, aligned: DataFrame) -> DataFrame:
    """(word, n_best, count_sum): by the counts of the linked pairs over the corpus."""
    each = aligned.select("word", "n", F.explode("links").alias("link"))
    counts = each.groupBy("link").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.expr("link & 4294967295L"))
    pairs = scratch.settle(counts.withColumn("best", F.col("count") == F.max("count").over(of_b)))
    few = pairs.count() <= PAIRS_SENT
    return each.join(F.broadcast(pairs) if few else pairs, "link").groupBy("word").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, batch_bytes: int = 32 << 20, slices: int = 3) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): a row for each row of docs.

    groups: ``a1,a2|b1;a3|b2,b3`` in decimal ids. path_a: a byte-level BPE file of the tokenizers library; path_b: a
    sentencepiece model. slices: of how many parts of the batches one at a time has shuffle files on the way back. What meets in one task of a batch is about its bytes once more for its codes and its distinct stretches.
    """
    spark, paths = docs.sparkSession, (path_a, path_b)
    scratch = Scratch(spark, "align")
    n = parts(spark)
    coded = scratch.settle(code_batches(docs, _splitter(paths), most_bytes=batch_bytes))
    places = batch_words(coded).drop("tag")
    words = scratch.settle(_encode(places.groupBy("word").agg(F.sum("n").alias("n")), paths).withColumn("word_id", F.monotonically_increasing_id()))
    # Dealt by stretch once, for the first windows and both sides of the join; the full join's rows are dealt once more.
    once = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    aligned = scratch.settle(align_words(words.repartition(n, "word_id")), once)
    scratch.drop(words)
    numbers = scratch.settle(_with_counts(scratch, aligned))
    info = scratch.settle(aligned.select("word", "n_a", "n_b", "n_groups", "groups").join(numbers, "word"))
    scratch.drop(aligned, numbers)
    found = _back(scratch, places.drop("n"), info, slices)
    scratch.drop(info)
    both = coded.select("batch", "ids", "codes").join(found, "batch", "left")
    rows = both.select(F.explode(F.transform(F.arrays_zip("ids", "codes"), _document)).alias("d")).select("d.*")
    # Each end of a token of either side closes one link, and an end of both closes one only.
    return rows.withColumn("n_links", F.col("n_a") + F.col("n_b") - F.col("n_groups")).select("doc_id", *NUMBERS[:3], "n_links", *NUMBERS[3:], "groups")


NUMBERS = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]


def _back(scratch: Scratch, places: DataFrame, info: DataFrame, slices: int) -> DataFrame:
    """(batch, w_groups, w_n_a, ...): for each batch its words' numbers and group strings in the order of their codes."""
    out = None
    for k in range(slices):
        mine = places.filter(F.pmod(F.xxhash64("batch"), F.lit(slices)) == k)
        found = mine.join(info, "word").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("code", "groups", *NUMBERS))).alias("x"))
        found = scratch.settle(found.select("batch", *[F.col(f"x.{c}").alias(f"w_{c}") for c in ("groups", *NUMBERS)]))
        out = found if out is None else out.unionByName(found)
    return out


def _document(d: Column) -> Column:
    """A document's sums over its codes, and its group strings joined; without codes all is zero or empty."""
    codes = d["codes"]

    def total(name: str) -> Column:
        return F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(F.get(F.col(f"w_{name}"), c - 1), F.lit(0)))

    text = F.array_join(F.transform(codes, lambda c: F.get(F.col("w_groups"), c - 1)), "")
    return F.struct(d["ids"].alias("doc_id"), *[total(c).alias(c) for c in NUMBERS], F.rtrim(text, F.lit(";")).alias("groups"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents"))
    return out.withColumn("groups_sha256", F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))).drop("groups")
