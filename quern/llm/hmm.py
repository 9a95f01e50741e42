"""Hidden Markov language model over words, with exact sequence likelihoods.

Texts become sequences of words (A-Z lower-cased, split at ASCII white space) and
one end. The most frequent words by exact counts over all training texts (``head``
of them, or as many as grow with the root of the training tokens) are symbols of their own; all others are the symbol RARE, and which rare word it
is has the probability (c + 0.1) / (N_rare + 0.1 (V_rare + 1)) from exact counts over all
training texts; an unseen word is the one extra. So the score of a text is the
model's probability of exactly that text.

One pass writes every text's symbols (compressed) and its rare words as (64-bit
hash, text, count) in buckets of the hash. A bucket counts its words over all
training texts and answers each text with its sum of log10(c + 0.1). Baum-Welch
starts from an expectation maximisation on a bounded sample and then runs over
all training texts until a pass raises their log likelihood by less than the
share ``settle`` (``rounds`` passes at most). Steps after the first go ``reach`` times as far as
plain ones, and a plain one follows a fall; the rise is compared with that of so many plain steps. Each task gathers expected counts
over whole texts, these are summed across tasks by blocks of symbols, a few tasks at a time,
and only the summed table, states x symbols, comes to the driver and goes out as single precision. Scoring is the
scaled forward recursion over whole texts, many texts side by side. A text of more than LONG
words is cut into segments that go side by side too; the matrices of the
segments, multiplied, give each the exact states before and after it, so that nothing is cut off.

Null and empty texts hold the end only. Repeated rows and ids get a result
each, and learn as often as they occur. Of equally frequent words the smaller bytes come first into the head. Without
training texts N and V are 0 and only the unseen word is left; an empty table
gives an empty result; other columns are left aside, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, parts, table, words_of

SEGMENT, GROUP, LONG, PART = 1024, 300_000, 1 << 17, 4096
TINY = 1e-30


class Model:
    """start (K), move (K x K), emit (symbols x K), rows of emit ordered by symbol."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.most = emit.max(axis=1) + emit.dtype.type(TINY)
        self.rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, rows: int, kind=None) -> np.ndarray:
        """An array of rows x states, used again from call to call: fresh memory costs more than the sums in it."""
        room = self.rooms.get(name)
        if room is None or len(room) < rows:
            room = self.rooms[name] = np.empty((rows * 5 // 4, len(self.start)), kind or self.emit.dtype)
        return room[:rows]

    @staticmethod
    def first(states: int, share: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.gamma(1.0, 1.0, (len(share), states))
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        """Expected counts, smoothed: a state keeps the more of the whole corpus's shares the more different symbols its counts hold."""
        s, m = start + 0.5, move + 0.1
        e = emit + (np.minimum(emit, 1.0).sum(0) + 1.0) * share[:, None]
        return Model(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0, keepdims=True))

    def beyond(self, new: Model, by: float) -> Model:
        """The model by times as far from this one as new is, in logarithms: an over-relaxed step of Baum-Welch."""
        def mix(a: np.ndarray, b: np.ndarray, axis: int) -> np.ndarray:
            x = np.exp((1 - by) * np.log(np.maximum(a, TINY)) + by * np.log(np.maximum(b, TINY)))
            return x / x.sum(axis, keepdims=True)

        return Model(mix(self.start, new.start, 0), mix(self.move, new.move, 1), mix(self.emit, new.emit, 0))

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each (non-empty) sequence: the scaled forward recursion, longest first; very long ones by segments."""
        out, short = np.zeros(len(sequences)), []
        for k, s in enumerate(sequences):
            if len(s) > LONG:
                out[k] = self.borders(s)[2]
            else:
                short.append(k)
        if short:
            steps = Steps([sequences[k] for k in short])
            total = np.zeros(len(short))
            alpha = None
            for t, n in enumerate(steps.active):
                b = self.emit[steps.symbols[steps.at[t] : steps.at[t] + n]]
                alpha = (self.start * b) if t == 0 else (alpha[:n] @ self.move) * b
                scale = alpha.sum(1) + TINY
                alpha /= scale[:, None]
                total[:n] += np.log10(scale)
            out[np.array(short)[steps.order]] = total
        return out

    def borders(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For the SEGMENT symbols from each multiple of SEGMENT: the shares of the states before the first, given all before;
        the values of the states after the last, given all after; and the log10 likelihood of the whole.

        A segment is a matrix from the states before it to those after it, and all segments go step by step side by side; the
        chain of the matrices then gives exactly what one recursion over the whole text gives.
        """
        n, k = -(-len(symbols) // SEGMENT), len(self.start)
        through, logs = np.empty((n, k, k)), np.empty(n)
        for lo in range(0, n, 256):  # blocks of bounded size
            part = symbols[lo * SEGMENT : (lo + 256) * SEGMENT].astype(np.int64)
            m = -(-len(part) // SEGMENT)
            x, size = np.broadcast_to(np.eye(k), (m, k, k)).copy(), np.zeros(m)
            for t in range(min(SEGMENT, len(part))):
                b = self.emit[part[t::SEGMENT]].astype(np.float64)
                r = len(b)
                y = (x[:r] * b[:, None]) @ self.move
                scale = y.sum((1, 2)) + TINY
                x[:r] = y / scale[:, None, None]
                size[:r] += np.log10(scale)
            through[lo : lo + m], logs[lo : lo + m] = x, size
        before, after = np.empty((n, k)), np.empty((n, k))
        q, total = self.start.astype(np.float64), float(logs.sum())
        for i in range(n):
            before[i] = q
            q = q @ through[i]
            total += float(np.log10(q.sum() + TINY))
            q /= q.sum() + TINY
        u = np.ones(k)
        for i in range(n - 1, -1, -1):
            after[i] = u
            u = through[i] @ u
            u /= u.sum() + TINY
        return before, after, total

    def expect(self, sequences: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray], before: np.ndarray | None = None, after: np.ndarray | None = None, opens: bool = True, closes: bool = True) -> float:
        """Adds the expected counts (start, move, emit) of whole sequences, exactly; gives their log10 likelihood.

        With before and after (rows of borders) the sequences are segments of one text in their order; opens and
        closes say whether the text's first and last are among them. Their likelihood is that of borders.
        """
        start, move, emit = counts
        steps, k = Steps(sequences), len(self.start)
        at, active, last, n = steps.at, steps.active, steps.last, len(steps.symbols)
        own, alpha, beta, weight = (self._room(x, n) for x in ("own", "alpha", "beta", "weight"))
        np.take(self.emit, steps.symbols, axis=0, out=own)
        top = self.most[steps.symbols]
        own /= top[:, None]  # so that every other step needs no scaling
        ones, scales = np.ones(k, own.dtype), np.ones(n, own.dtype)
        prior = np.broadcast_to(self.start, (len(sequences), k)) if before is None else before[steps.order].astype(own.dtype)
        for t, m in enumerate(active):
            lo = at[t]
            a = alpha[lo : lo + m]
            if t == 0:
                np.multiply(prior, own[:m], out=a)
            else:
                np.matmul(alpha[at[t - 1] : at[t - 1] + m], self.move, out=a)
                a *= own[lo : lo + m]
            if t % 2 == 0:
                s = a @ ones + TINY
                a /= s[:, None]
                scales[lo : lo + m] = s
        back = np.ascontiguousarray(self.move.T)
        follows = np.ones((len(sequences), k), own.dtype) if after is None else after[steps.order].astype(own.dtype)
        for t in range(len(active) - 1, -1, -1):
            m, lo = active[t], at[t]
            going = active[t + 1] if t + 1 < len(active) else 0
            b = beta[lo : lo + m]
            if going:
                np.matmul(weight[at[t + 1] : at[t + 1] + going], back, out=b[:going])
                if t % 2:
                    b[:going] /= (b[:going] @ ones + TINY)[:, None]
            if going < m:
                b[going:] = follows[going:m] @ back
            np.multiply(own[lo : lo + m], b, out=weight[lo : lo + m])
        gamma = np.multiply(alpha, beta, out=own)
        z = gamma @ ones + TINY
        gamma /= z[:, None]
        if len(active) > 1:
            first = at[1]
            weight[first:] /= (scales * z)[first:, None]
            previous = np.arange(first, n) - np.repeat(active[:-1], active[1:])
            move += self.move * (np.take(alpha, previous, axis=0, out=beta[first:]).T @ weight[first:])
        if after is None:
            start += gamma[: active[0]].sum(0)
        else:
            if closes:
                follows[np.argmax(steps.order)] = 0
            if opens:
                start += gamma[np.argmin(steps.order)]
            move += self.move * (alpha[last].T @ (follows / z[last][:, None]))
        for j in range(k):
            emit[:, j] += np.bincount(steps.symbols, weights=gamma[:, j], minlength=len(emit))
        end = alpha[last].sum(1, dtype=np.float64)
        return float(np.log10(scales).sum(dtype=np.float64) + np.log10(top).sum(dtype=np.float64) + np.log10(end + TINY).sum())


class Steps:
    """Sequences side by side, longest first: the symbols of each step lie together.

    order: the sequence at each place; active: how many have a step; at: where a step begins; last: where each place's last symbol is.
    """

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        at = np.concatenate([[0], np.cumsum(active)[:-1]])
        flat = np.concatenate([sequences[i] for i in self.order])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.symbols = np.empty(len(flat), np.int32)
        self.symbols[at[step] + np.repeat(np.arange(len(lengths)), lengths)] = flat
        self.last = at[lengths - 1] + np.arange(len(lengths))
        self.active, self.at = active.tolist(), at.tolist()


def expect_all(model: Model, texts, counts) -> float:
    """model.expect over texts, short and long ones apart, in groups of bounded size; gives their log10 likelihood."""
    pools, total = {False: [], True: []}, 0.0
    size, longest = dict.fromkeys(pools, 0), dict.fromkeys(pools, 1)
    for symbols in texts:
        if len(symbols) > LONG:
            total += _expect_long(model, symbols, counts)
            continue
        pool = len(symbols) > SEGMENT
        pools[pool].append(symbols)
        size[pool] += len(symbols)
        longest[pool] = max(longest[pool], len(symbols))
        if size[pool] >= min(2 * GROUP, max(GROUP, 100 * longest[pool])):  # long steps want many texts side by side
            total += model.expect(pools[pool], counts)
            pools[pool], size[pool], longest[pool] = [], 0, 1
    return total + sum(model.expect(p, counts) for p in pools.values() if p)


def _expect_long(model: Model, symbols: np.ndarray, counts) -> float:
    """model.expect of one text of any length, its segments side by side in blocks of bounded size."""
    before, after, total = model.borders(symbols)
    n, each = len(before), GROUP // SEGMENT
    for lo in range(0, n, each):
        hi = min(n, lo + each)
        whole = [symbols[i * SEGMENT : (i + 1) * SEGMENT] for i in range(lo, hi)]
        model.expect(whole, counts, before[lo:hi], after[lo:hi], lo == 0, hi == n)
    return total


def pack_symbols(a: np.ndarray) -> bytes:
    kind = 2 if a.max(initial=0) < 1 << 16 else 4
    return bytes([kind]) + zstandard.ZstdCompressor(level=1).compress(a.astype(f"<u{kind}").tobytes())


def unpack_symbols(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), f"<u{b[0]}")


ROWS = "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, bucket int, base long, h binary, i binary, tf binary"
NAMES = [f.split()[0] for f in ROWS.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(NAMES, KINDS, strict=True)], NAMES)


def _read_pass(head: dict[bytes, int], buckets: int):
    """Every text's symbols, and its rare words by bucket: h (hash), i (text within the batch; the sign marks training), tf."""
    rare, end = len(head), len(head) + 1

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                rows, hashes, owner, times = [], [], [], []
                seen: dict[bytes, int] = {}
                for i, (d, held, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True)):
                    words = words_of(text)
                    symbols = np.fromiter((head.get(w, rare) for w in words), np.int32, len(words))
                    rows.append({"row": at + i, "doc_id": d, "held_out": held, "n_tokens": len(words) + 1, "symbols": pack_symbols(np.append(symbols, end))})
                    tail = Counter(words[j] for j in np.flatnonzero(symbols == rare).tolist())
                    for w, n in tail.items():
                        h = seen.get(w)
                        if h is None:
                            h = seen[w] = xxhash.xxh64_intdigest(w, 42)
                        hashes.append(h)
                        owner.append(i if held else ~i)
                        times.append(n)
                yield _batch(rows)
                h, o, n = np.array(hashes, np.uint64), np.array(owner, np.int32), np.array(times, np.int32)
                k = (h >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(k, kind="stable")
                cuts = np.searchsorted(k[order], np.arange(buckets + 1))
                out = []
                for c in np.flatnonzero(np.diff(cuts)).tolist():
                    s = order[cuts[c] : cuts[c + 1]]
                    out.append({"bucket": c, "base": at, "h": h[s].tobytes(), "i": o[s].tobytes(), "tf": n[s].tobytes()})
                if out:
                    yield _batch(out)
                at += b.num_rows

    return run


def _count_bucket(batches):
    """Answers of a bucket, read in order of bucket: per batch of texts the sum of log10(c + 0.1) and the known tokens; last its V and N."""

    def flush(held):
        h = np.concatenate([np.frombuffer(r[1], np.uint64) for r in held])
        o = np.concatenate([np.frombuffer(r[2], np.int32) for r in held])
        n = np.concatenate([np.frombuffer(r[3], np.int32) for r in held]).astype(np.int64)
        words, inverse = np.unique(h, return_inverse=True)
        c = np.bincount(inverse, weights=np.where(o < 0, n, 0), minlength=len(words))
        value, known = n * np.log10(c + 0.1)[inverse], n * (c[inverse] > 0)
        at = 0
        for base, hb, *_ in held:
            m = len(hb) // 8
            i = o[at : at + m]
            i = np.where(i < 0, ~i, i)
            docs, back = np.unique(i, return_inverse=True)
            s = np.bincount(back, weights=value[at : at + m])
            k = np.bincount(back, weights=known[at : at + m]).astype(np.int64)
            yield {"base": base, "i": docs.astype(np.int32).tobytes(), "s": s.tobytes(), "k": k.tobytes()}
            at += m
        yield {"v": int((c > 0).sum()), "n": int(c.sum())}

    def rows(it):
        held, now = [], None
        for b in it:
            for bucket, *rest in zip(*(b.column(c).to_pylist() for c in ("bucket", "base", "h", "i", "tf")), strict=True):
                if bucket != now and held:
                    yield from flush(held)
                    held = []
                now = bucket
                held.append(rest)
        if held:
            yield from flush(held)

    out = []
    for r in rows(batches):
        out.append(r)
        if len(out) == 256:
            yield pa.RecordBatch.from_pylist(out, ANSWER)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, ANSWER)


ANSWER = pa.schema([("base", pa.int64()), ("i", pa.binary()), ("s", pa.binary()), ("k", pa.binary()), ("v", pa.int64()), ("n", pa.int64())])


def _gather(batches):
    """Sums the answers of each batch of texts, read in order of base."""

    def flush(base, held):
        i = np.concatenate([np.frombuffer(r[0], np.int32) for r in held])
        s = np.concatenate([np.frombuffer(r[1], np.float64) for r in held])
        k = np.concatenate([np.frombuffer(r[2], np.int64) for r in held])
        docs, back = np.unique(i, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(base + docs.astype(np.int64)), pa.array(np.bincount(back, weights=s)), pa.array(np.bincount(back, weights=k).astype(np.int64))], ["row", "s", "k"])

    held, now = [], None
    for b in batches:
        for base, *rest in zip(*(b.column(c).to_pylist() for c in ("base", "i", "s", "k")), strict=True):
            if base != now and held:
                yield flush(now, held)
                held = []
            now = base
            held.append(rest)
    if held:
        yield flush(now, held)


def _sum_table(rows: DataFrame, width: int, states: int, fan: int = 64) -> np.ndarray:
    """Adds (task, part, table) rows part by part across tasks, and gives all parts: at most states x symbols numbers.

    Tables of fan tasks are added first, then those sums by fan, until few are left, so that no reducer reads more than
    fan tables of a part.
    """

    def add(batches, kind):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for k, p, t in zip(*(b.column(c).to_pylist() for c in ("task", "part", "table")), strict=True):
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(t), kind).astype(np.float64)
                if (k, p) in sums:
                    sums[k, p] += x
                else:
                    sums[k, p] = x
        for (k, p), x in sums.items():
            yield pa.RecordBatch.from_pydict({"task": pa.array([k], pa.int32()), "part": pa.array([p], pa.int32()), "table": pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes())], pa.binary())})

    n_parts, tasks, most = -(-width // PART), rows.rdd.getNumPartitions(), parts(rows.sparkSession)
    kind = "<f4"  # single tasks' tables; sums have double precision
    while tasks > 1:
        tasks = -(-tasks // fan)
        dealt = rows.withColumn("task", F.expr(f"task div {fan}").cast("int")).repartition(min(n_parts * tasks, most), "task", "part")
        rows, kind = dealt.mapInArrow(lambda it, kind=kind: add(it, kind), "task int, part int, table binary"), "<f8"
    got = rows.select("part", "table").toArrow()
    out = np.zeros((n_parts * PART, states))
    for p, t in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        x = np.frombuffer(zstandard.ZstdDecompressor().decompress(t), kind).reshape(-1, states)
        out[p * PART : p * PART + len(x)] += x
    return out[:width]


def head_size(n_words: int) -> int:
    """Words with emissions of their own, for so many training words."""
    return max(60_000, int(7 * n_words**0.5))


def held_out_tenth(doc_id):
    return crc_mod(doc_id, 10) == 0


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=held_out_tenth, states: int = 16, head: int | None = None, sample: int = 3000, rounds: int = 50, settle: float = 5e-4, reach: float = 1.8) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of df."""
    spark, scratch, n_parts = df.sparkSession, Scratch(df.sparkSession, "hmm"), parts(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    learn = rows.where(~F.col("held_out"))

    def tally(batches):
        c: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["w", "n"])
        for b in batches:
            for t in b.column("text").to_pylist():
                c.update(words_of(t))
                if len(c) > 500_000:
                    yield give()
                    c.clear()
        yield give()

    words = scratch.write(learn.select("text").mapInArrow(tally, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")))
    n_words = int(words.agg(F.sum("n")).collect()[0][0] or 0)
    most = head or head_size(n_words)
    sizes = words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toArrow()  # one row for each count that occurs
    over = np.cumsum(sizes.column("k").to_numpy()) >= most
    least = int(sizes.column("n").to_numpy()[over.argmax()]) if over.any() else 0
    frequent = words.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most).toArrow().column("w").to_pylist()
    numbers = {w: i for i, w in enumerate(frequent)}  # at most ``most`` words
    rare, end, width = len(numbers), len(numbers) + 1, len(numbers) + 2
    shared = spark.sparkContext.broadcast(numbers)
    buckets = max(n_parts, 16)
    made = scratch.write(rows.mapInArrow(lambda it: _read_pass(shared.value, buckets)(it), ROWS))
    docs = made.where("row is not null").select("row", "doc_id", "held_out", "n_tokens", "symbols")
    train = docs.where(~F.col("held_out")).select("row", "symbols")

    tail = made.where("bucket is not null").select("bucket", "base", "h", "i", "tf").repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    answers = scratch.write(tail.mapInArrow(_count_bucket, "base long, i binary, s binary, k binary, v long, n long"))
    v_rare, n_rare = (int(x or 0) for x in answers.agg(F.sum("v"), F.sum("n")).collect()[0])
    sums = answers.where("base is not null").select("base", "i", "s", "k").repartition(n_parts, "base").sortWithinPartitions("base").mapInArrow(_gather, "row long, s double, k long")

    def put(table_: np.ndarray):
        for p in range(0, len(table_), PART):
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "part": pa.array([p // PART], pa.int32()), "table": pa.array([zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(table_[p : p + PART], "<f4").tobytes())], pa.binary())})

    def count_exact(batches):
        c = np.zeros(width, np.int64)
        for b in batches:
            for s in b.column("symbols").to_pylist():
                x, n = np.unique(unpack_symbols(s), return_counts=True)
                c[x] += n
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[at])], ["x", "n"])

    counted = train.mapInArrow(count_exact, "x int, n long").groupBy("x").agg(F.sum("n").alias("n")).toArrow()  # at most width rows
    c = np.zeros(width, np.int64)
    c[counted.column("x").to_numpy()] = counted.column("n").to_numpy()
    total, kinds = int(c.sum()), int((c[:rare] > 0).sum()) + int(c[end] > 0) + v_rare
    share = (c + 0.1) / (c + 0.1).sum()

    def first_model(batches):
        texts = [unpack_symbols(s) for b in batches for s in b.column("symbols").to_pylist()]
        model = Model.first(states, share)
        for _ in range(20):
            counts = (np.zeros(states), np.zeros((states, states)), np.zeros((width, states), order="F"))
            expect_all(model, texts, counts)
            model = Model.of_counts(*counts, share)
        yield pa.RecordBatch.from_pydict({"m": [np.concatenate([model.start, model.move.ravel(), model.emit.ravel()]).astype("<f8").tobytes()]})

    chosen = train.join(F.broadcast(train.select("row").orderBy(F.xxhash64("row"), "row").limit(sample)), "row").select("symbols")
    first = np.frombuffer(chosen.repartition(1).mapInArrow(first_model, "m binary").collect()[0]["m"], "<f8") if total else None
    cut = lambda a: Model(a[:states], a[states : states + states**2].reshape(states, states), a[states + states**2 :].reshape(width, states))
    model = cut(first) if total else Model.first(states, share)
    last, far = None, 1.0
    for _ in range(rounds if total else 0):
        sent = spark.sparkContext.broadcast(Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit))))

        def expect(batches, sent=sent):
            counts = (np.zeros(states), np.zeros((states, states)), np.zeros((width, states), order="F"))
            likelihood = expect_all(sent.value, (unpack_symbols(s) for b in batches for s in b.column("symbols").to_pylist()), counts)
            yield from put(np.vstack([counts[2], counts[0][None], counts[1], np.full((1, states), likelihood)]))

        got = _sum_table(train.mapInArrow(expect, "task int, part int, table binary"), width + 2 + states, states)
        sent.unpersist()
        spark._jvm.System.gc()  # lets go of the tables that the pass shuffled
        step, now = Model.of_counts(got[width], got[width + 1 : -1], got[:width], share), float(got[-1, 0])
        fell = last is not None and now < last
        if last is not None and not fell and now - last < settle * far * abs(now):
            model = step
            break
        far = 1.0 if last is None or fell else reach  # the first step is long by itself; after a fall a plain one
        model, last = model.beyond(step, far) if far > 1 else step, now

    sent = spark.sparkContext.broadcast((model, np.log10(c + 0.1), c > 0))

    def score(batches):
        for whole in batches:
            model, logs, known = sent.value
            for lo in range(0, whole.num_rows, 4000):
                b = whole.slice(lo, 4000)
                texts = [unpack_symbols(s) for s in b.column("symbols").to_pylist()]
                flat, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                dense = flat != rare
                base = np.add.reduceat(np.where(dense, logs[flat], 0.0), starts)
                have = np.add.reduceat((dense & known[flat]).astype(np.int64), starts)
                rares = np.add.reduceat((~dense).astype(np.int64), starts)
                cols = [b.column("row"), b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), pa.array(base), pa.array(have), pa.array(rares), pa.array(model.log10(texts))]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "held_out", "n_tokens", "b", "have", "rares", "f"])

    scored = docs.mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, b double, have long, rares long, f double")
    joined = scored.join(sums, "row", "left").withColumns({"s": F.coalesce("s", F.lit(0.0)), "k": F.coalesce("k", F.lit(0))})
    base_den, rare_den = float(np.log10(total + 0.1 * (kinds + 1))), float(np.log10(n_rare + 0.1 * (v_rare + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("have") + F.col("k")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("b") + F.col("s") - F.col("n_tokens") * F.lit(base_den)).alias("base_score"),
        (F.col("f") + F.col("s") - F.col("rares") * F.lit(rare_den)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the score of every document."""
    return score_texts(table(spark, sf_dir, "documents"))
