"""Phrase collocations: dictionary-encoded words, packed n-grams, range-partitioned radix sort, run lengths.

1. Texts become batches of codes (batches.py); words with enough occurrences in their language get an id.
2. In each batch the ids stand where their words stood, and 0 for all others and for the ends of pieces. Each
   position that starts a phrase is packed into a key of 16 bytes, four ids of 32 bits, filled with 0 from the first
   break on; so one key stands for the phrases of two, three and four words that start there. The keys are radix
   sorted and equal ones counted by the lengths of their runs.
3. Keys are dealt to ranges whose bounds come from a bounded number of the batches' own keys; a range's blocks are
   sorted together, and the runs of whole keys and of their prefixes are the counts of phrases. A phrase that meets a
   range's first or last key may go on in the next range, so it is reported however rare; the sum over ranges decides.
4. Cuts, the score, containment and ranks are joins and aggregates over the phrases left.

Null text: empty; null lang: ``und``. Null and repeated doc_ids do not matter, since nothing is told per document;
repeated rows count each. Other columns are left aside, whatever their names. No phrases: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import BREAK, batch_words, code_batches
from .common import LARGE_ROWS, SMALL_BATCHES, Scratch, parts, table

LONGEST = 4
#: Fixed values of the rule: where pieces end, what parts words.
ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_TABLE = bytes(BREAK[0] if c in ENDS else 32 if c in GAPS else c for c in range(256))
#: About so many keys meet in a range, and so many batches show their keys for the bounds of ranges.
RANGE_KEYS, SHOWN = 1_000_000, 1024
W = [f"w{k}" for k in range(1, LONGEST + 1)]
MASK = np.uint64(0xFFFFFFFF)
KEYS = np.dtype([("hi", ">u8"), ("lo", ">u8")])


def words_and_breaks(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, and BREAK where a piece ends, also at the text's end."""
    return [*text.encode("utf-8", "replace").lower().translate(_TABLE).replace(BREAK, b" " + BREAK + b" ").split(), BREAK]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (high, low half) of all positions that start a phrase of two words or more."""
    ids = np.concatenate([ids.astype(np.uint64), np.zeros(LONGEST, np.uint64)])
    n = len(ids) - LONGEST
    here = np.flatnonzero((ids[:n] != 0) & (ids[1 : n + 1] != 0))
    third = ids[here + 2]
    fourth = np.where(third != 0, ids[here + 3], np.uint64(0))
    return ids[here] << np.uint64(32) | ids[here + 1], third << np.uint64(32) | fourth


def radix_order(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The order of keys by 16-bit digits, last digit first; numpy's stable sort of such digits is a radix sort."""
    order = np.arange(len(hi))
    for half in (lo, hi):
        for shift in (0, 16, 32, 48):
            digit = (half >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with the sums of their counts (1 each where none are given)."""
    order = radix_order(hi, lo)
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
    if counts is None:
        n = np.diff(np.append(first, len(hi)))
    else:
        n = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
    return hi[first], lo[first], n.astype(np.int64)


def to_block(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and counts by byte planes, compressed: the planes of sorted keys are mostly long runs."""
    keys = np.empty(len(hi), KEYS)
    keys["hi"], keys["lo"] = hi, lo
    planes = keys.view(np.uint8).reshape(-1, 16).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes + n.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def from_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(24, -1)
    keys = np.ascontiguousarray(planes[:16].T).view(KEYS).reshape(-1)
    return keys["hi"].astype(np.uint64), keys["lo"].astype(np.uint64), np.ascontiguousarray(planes[16:].T).view("<u8").reshape(-1).astype(np.int64)


def _dictionary(scratch: Scratch, words: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, f): words with enough occurrences; ids from 1, without gaps."""
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    kept = scratch.settle(often.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted(kept.groupBy(part.alias("part")).count().collect())  # a number for each task of the step before
    total, starts = 0, []
    for p, n in sizes:
        starts.append((p, total))
        total += n
    if total >= 1 << 32:
        raise ValueError(f"{total} words occur {least} times or more; keys hold 32 bits a word")
    offsets = scratch.spark.createDataFrame(starts or [(0, 0)], "part long, start long")
    return kept.withColumn("part", part).join(F.broadcast(offsets), "part").select((F.col("start") + F.col("at") % (1 << 33) + 1).alias("id"), "lang", "word", "f")


def shown_keys(hi: np.ndarray, lo: np.ndarray, batch: int) -> bytes:
    """Some of a batch's sorted keys, evenly spaced from a start of its own, or else all batches would show about the same keys."""
    shown = np.empty(min(256, len(hi)), KEYS)
    start = batch * 0x9E3779B97F4A7C15 % (1 << 64) / (1 << 64)
    some = np.minimum(((np.arange(len(shown)) + start) * (len(hi) / max(1, len(shown)))).astype(np.int64), len(hi) - 1)
    shown["hi"], shown["lo"] = hi[some], lo[some]
    return shown.tobytes()


def _blocks(coded: DataFrame, places: DataFrame) -> DataFrame:
    """(batch, keys, block, shown): each batch's sorted keys, and some of them evenly spaced."""

    def run(key: tuple, batch: pa.Table, ids: pa.Table) -> pa.Table:
        codes = batch.column("codes")[0].values.flatten().to_numpy(zero_copy_only=False)
        lookup = np.zeros(int(codes.max(initial=0)) + 1, np.uint64)
        lookup[ids.column("code").to_numpy()] = ids.column("id").to_numpy()
        keys = run_lengths(*pack(lookup[codes]))
        at = key[0].as_py()
        return pa.table({"batch": pa.array([at], pa.int64()), "keys": pa.array([len(keys[0])], pa.int64()), "block": pa.array([to_block(*keys)], pa.binary()), "shown": pa.array([shown_keys(keys[0], keys[1], at)], pa.binary())})

    ids = places.select(F.col("batch").alias("of"), "code", "id").groupBy("of")
    return coded.select("batch", "codes").groupBy("batch").cogroup(ids).applyInArrow(run, "batch long, keys long, block binary, shown binary")


def _bounds(blocks: DataFrame, ranges: int) -> np.ndarray:
    """Keys that part the ranges, from the evenly spaced keys of at most some SHOWN batches, weighed by their batches' sizes."""
    total = blocks.count()
    some = blocks if total <= SHOWN else blocks.filter(F.pmod(F.xxhash64("batch"), F.lit(-(-total // SHOWN))) == 0)
    keys, weights = [np.zeros(0, KEYS)], [np.zeros(0)]
    for row in some.select("keys", "shown").collect():
        k = np.frombuffer(row.shown, KEYS)
        if len(k):
            keys.append(k)
            weights.append(np.full(len(k), row["keys"] / len(k)))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = radix_order(keys["hi"].astype(np.uint64), keys["lo"].astype(np.uint64))
    reached = np.cumsum(weights[order])
    if ranges < 2 or not len(order):
        return np.zeros(0, KEYS)
    cuts = np.searchsorted(reached, reached[-1] * np.arange(1, ranges) / ranges)
    return np.unique(keys[order][np.minimum(cuts, len(order) - 1)])


def _deal(blocks: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(range, block): each block cut at the bounds of ranges; a range holds the keys from its bound on."""

    def run(batches):
        upper, lower = bounds["hi"].astype(np.uint64), bounds["lo"].astype(np.uint64)
        for b in batches:
            for block in b.column("block"):
                hi, lo, n = from_block(block.as_py())
                left, right = np.searchsorted(hi, upper, "left"), np.searchsorted(hi, upper, "right")
                cuts = [0, *(int(i + np.searchsorted(lo[i:j], x)) for i, j, x in zip(left, right, lower, strict=True)), len(hi)]
                found = [(k, to_block(hi[i:j], lo[i:j], n[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
                yield pa.RecordBatch.from_pydict({"range": pa.array([k for k, _ in found], pa.int32()), "block": pa.array([x for _, x in found], pa.binary())})

    return blocks.select("block").mapInArrow(run, "range int, block binary")


def phrase_runs(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys with counts: the ids (a row each of four) and counts of phrases that occur often or lie at either end."""
    found, counts = [], []
    third = MASK << np.uint64(32)
    for rest, end in ((np.zeros_like(lo), hi), (lo & third, lo & third), (lo, lo & MASK)):  # third and fourth word of phrases of 2, 3 and 4, and their last
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (rest[1:] != rest[:-1])]))
        total = np.add.reduceat(n, first)
        keep = total >= least
        keep[[0, -1]] = True
        keep &= end[first] != 0
        of, rest = hi[first[keep]], rest[first[keep]]
        found.append(np.stack([of >> np.uint64(32), of & MASK, rest >> np.uint64(32), rest & MASK], 1))
        counts.append(total[keep])
    return np.concatenate(found), np.concatenate(counts)


def _count(dealt: DataFrame, least: int) -> DataFrame:
    """(w1 .. w4, f): phrases of a range; keys of all blocks are merged by sorting them anew."""

    def run(t: pa.Table) -> pa.Table:
        read = [from_block(x.as_py()) for x in t.column("block")]
        ids, n = phrase_runs(*run_lengths(*(np.concatenate(x) for x in zip(*read, strict=True))), least)
        return pa.table({**{w: pa.array(ids[:, k].astype(np.int64)) for k, w in enumerate(W)}, "f": pa.array(n, pa.int64())})

    return dealt.groupBy("range").applyInArrow(run, ", ".join(f"{w} long" for w in W) + ", f long")


def phrase_counts(docs: DataFrame, least: int = 30, scratch: Scratch | None = None, range_keys: int = RANGE_KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dictionary (id, lang, word, f), phrases (w1 .. w4, f) of 2 to 4 words, sizes (lang, n)), exact, for f >= least.

    Ids are of words of one language, so a phrase needs no language of its own; 0 fills the places after its last word.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "collocations")
    named = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    coded = scratch.settle(code_batches(named, words_and_breaks, "lang"), SMALL_BATCHES, LARGE_ROWS)
    words = batch_words(coded).withColumnRenamed("tag", "lang")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    dictionary = scratch.write(_dictionary(scratch, words, least))
    sizes = scratch.settle(sizes)
    places = words.select("batch", "code", "lang", "word").join(dictionary.select("lang", "word", "id"), ["lang", "word"])
    blocks = scratch.settle(_blocks(coded, places), SMALL_BATCHES, LARGE_ROWS)
    scratch.drop(coded)
    keys = blocks.agg(F.sum("keys")).first()[0] or 0
    dealt = _deal(blocks, _bounds(blocks, max(parts(spark) if keys > 50_000 else 1, -(-keys // range_keys))))
    phrases = scratch.settle(_count(dealt, least).groupBy(*W).agg(F.sum("f").alias("f")).filter(F.col("f") >= least), SMALL_BATCHES)
    scratch.drop(blocks)
    return dictionary, phrases, sizes


def _key(cols: list[Column]) -> Column:
    return F.array(*cols, *[F.lit(0).cast("long")] * (LONGEST - len(cols)))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, scale: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Of the cuts of a phrase with a occurrences into two parts with l and r the lowest floor(scale * a / (l + r)) counts
    (ties: the shortest first part); a phrase inside a longer one with at least share percent of its occurrences goes.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    dictionary, phrases, sizes = phrase_counts(docs, least, scratch)
    length = sum((F.col(w) != 0).cast("int") for w in W)
    phrases = phrases.select(_key([F.col(w) for w in W]).alias("key"), length.alias("words"), F.col("f").alias("a"))
    counts = phrases.select("key", F.col("a").alias("f")).unionByName(dictionary.select(_key([F.col("id")]).alias("key"), "f"))

    def part(at: int, of: int) -> Column:
        return _key([F.get("key", F.lit(at + i)) for i in range(of)])

    cuts = F.array(*[F.when(F.lit(k) < F.col("words"), F.struct(F.lit(k).alias("k"), part(0, k).alias("left"), F.when(F.col("words") - k == 1, part(k, 1)).when(F.col("words") - k == 2, part(k, 2)).otherwise(part(k, 3)).alias("right"))) for k in range(1, LONGEST)])
    cut = phrases.withColumn("cut", F.explode(F.filter(cuts, lambda x: x.isNotNull()))).select("key", "words", "a", "cut.*")
    cut = cut.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    cut = cut.withColumn("score", F.expr(f"cast(a as decimal(20, 0)) * cast({scale} as decimal(10, 0)) div (cast(l as decimal(20, 0)) + r)"))
    scored = cut.groupBy("key", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = [(at, of) for of in range(2, LONGEST) for at in range(LONGEST - of + 1)]
    inside = F.array(*[F.when((F.col("words") >= at + of) & (F.col("words") > of), part(at, of)) for at, of in inner])
    longer = phrases.filter(F.col("words") > 2).select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, "key", "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    kept = kept.select("key", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))

    first = dictionary.select(F.col("id").alias("i1"), "lang", F.col("word").alias("p1"))
    rows = kept.withColumn("i1", F.get("key", F.lit(0))).join(first, "i1")
    # Ranked in salted groups first, so that no task gets all phrases of a language.
    best, salted = [F.desc("score"), F.desc("a")], ["lang", F.pmod(F.xxhash64("key"), F.lit(64))]
    rows = rows.withColumn("rank", F.rank().over(Window.partitionBy(*salted).orderBy(*best))).filter(F.col("rank") <= top).drop("rank")
    for k in range(2, LONGEST + 1):
        rows = rows.withColumn(f"i{k}", F.get("key", F.lit(k - 1))).join(dictionary.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"p{k}")), f"i{k}", "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"p{k}" for k in range(1, LONGEST + 1)]))
    best = [*best, F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*salted).orderBy(*best))).filter(F.col("rank") <= top)
    last = Window.partitionBy("lang").orderBy(*best)
    rows = rows.withColumn("rank", F.row_number().over(last).cast("long")).filter(F.col("rank") <= top)
    return rows.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
words AS (SELECT lang, id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w1 FROM numbered),
starts AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM starts
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM starts WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM starts WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM starts WHERE w4 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE a >= 30),
c AS (SELECT lang, k AS words, phrase, string_split(phrase, ' ') AS ws, a FROM often WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.words, c.a, k.k, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a)::HUGEINT)::BIGINT AS score
  FROM c JOIN (SELECT unnest([1, 2, 3]) AS k) k ON k.k < c.words
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k.k], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k.k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
subs AS (
  SELECT c.lang, array_to_string(c.ws[s.first:s.first + s.width - 1], ' ') AS phrase, max(c.a) AS longer
  FROM c JOIN (SELECT * FROM (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) t(first, width)) s ON s.width < c.words AND s.first + s.width - 1 <= c.words
  GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN subs USING (lang, phrase) WHERE subs.longer IS NULL OR 100 * subs.longer < 80 * best.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT kept.*, n.n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept JOIN n USING (lang))
WHERE rank <= 2000
"""
