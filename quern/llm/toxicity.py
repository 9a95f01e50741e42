"""Toxicity: noisy-channel deobfuscation, then a lexicon score of the restored text.

A character trigram model is counted over all training documents. A word that
holds digits or symbols between its letters, or a letter three times in a row,
and a run of single characters with spaces between, make a lattice: leetspeak
characters have letters as alternatives, separators may be dropped or end a
word, runs of a letter may shrink to one or two. Viterbi decoding under the
character model picks the restored spelling. A plain word's lattice has one
path, the word itself. All words, as written and as restored, are scored.

The classifier is fitted on a bounded sample of labelled rows (``max_toxic`` and
``max_clean`` ids, least hash of the id first, one row an id): word prefixes and whole words
that occur in toxic documents in several different contexts (so that copies of
one document count once) get a log-odds weight, and a logistic curve over the
strongest weights of a document gives the score. The sample is fitted in
one task; everything else reads every row, and whole texts.

Null and empty texts hold no word and get the score of no evidence. Without
labels of both classes every score is 0.5 or less and nothing is rejected.
A text may have any length; each different token is decoded once. Of paths of equal cost the
last state in order wins, and of ids of equal hash the smaller is sampled. An id labelled
both ways counts as toxic. Repeated rows get a result each, and of an id's
rows the first text in order is learnt from; ids may be null (they count as training rows
of the character model). An empty table gives an empty result; other columns are left
aside (kept by drop_toxic), whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, table

EDGE = "*.,;:!?\"'()[]{}<>|&#%~^=/\\`"
SPACED = re.compile(r"(?:(?<=\s)|^)[\w@$!](?: [\w@$!]){2,}(?=\s|$)")
TRIPLE = re.compile(r"(.)\1\1")
TAIL = re.compile(r"([^\w\s])\1{2,}$")
#: Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Edges that stand for no letter.
ORNAMENT = "".join(c for c in EDGE if c not in LEET)
NUMBER = re.compile(r"[$€£+(!|]*\d[\d.,:/%()+-]*[€£$%]?[)!|]*")
SEPARATORS = " .-_*~'`,"
SWAP, DROP, SPLIT, SHRINK, KEEP = 0.7, 0.5, 1.0, 0.3, 6.0
#: Characters of a token after which the lattice behind is settled.
SETTLE = 256
SIZE = 64


def _class_table() -> np.ndarray:
    """Class of a code point: 0 no letter, 1-26 a-z, then the small letters of Latin-1, last all other letters."""
    out = np.zeros(0x110000 >> 4, np.uint8)  # enough for the code points below 0x11000; the rest are folded to the end
    for c in range(len(out)):
        ch = chr(c)
        if "a" <= ch <= "z":
            out[c] = c - 96
        elif 0xDF <= c <= 0xFF and c != 0xF7:
            out[c] = 27 + c - 0xDF
        elif ch.isalpha():
            out[c] = SIZE - 1
    return out


CLASSES = _class_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return CLASSES[np.minimum(points, len(CLASSES) - 1)].astype(np.int64)


def count_trigrams(texts: list[str], counts: np.ndarray) -> None:
    """Adds the letter trigrams of texts; word ends count as class 0."""
    held, size = [], 0
    for k, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size > 2_000_000 or k + 1 == len(texts):
            c = classes("  ".join(["", *held, ""]).lower())
            counts += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
            held, size = [], 0


class CharModel:
    """Log probabilities of a class after two classes, smoothed by the shorter histories."""

    def __init__(self, counts: np.ndarray, weight: float = 5.0):
        n = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        uni = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * SIZE)
        two = n.sum(0)
        bi = (two + weight * uni) / (two.sum(1, keepdims=True) + weight)
        tri = (n + weight * bi[None]) / (n.sum(2, keepdims=True) + weight)
        self.log = np.log(tri).astype(np.float32)

    def decode(self, token: str) -> str:
        """The likeliest restored spelling; word breaks are spaces."""
        log, n = self.log, len(token)
        paths: dict[int, dict] = {0: {(0, 0): (0.0, None, "")}}
        done: list[str] = []
        due = SETTLE
        for i in range(n):
            here = paths.get(i)
            if not here:
                continue
            if i >= due:
                self._settle(paths, i, done)
                here, due = paths[i], i + SETTLE
            arcs = self._arcs(token, i)
            for state, (score, _, _) in here.items():
                for step, out, cost in arcs:
                    a, b = state
                    s = score - cost
                    for ch in out:
                        c = int(CLASSES[min(ord(ch), len(CLASSES) - 1)])
                        s += float(log[a, b, c])
                        a, b = b, c
                    to = paths.setdefault(i + step, {})
                    if (a, b) not in to or s > to[(a, b)][0]:
                        to[(a, b)] = (s, (i, state), out)
        end = max(paths[n], key=lambda st: (paths[n][st][0] + float(log[st[0], st[1], 0]), st))
        return "".join([*done, self._written(paths, (n, end))])

    @staticmethod
    def _written(paths: dict[int, dict], at: tuple | None) -> str:
        """What the path to a node writes since its root, the node without one before it."""
        out = []
        while at is not None:
            _, at, o = paths[at[0]][at[1]]
            out.append(o)
        return "".join(reversed(out))

    def _settle(self, paths: dict[int, dict], i: int, done: list[str]) -> None:
        """Forgets what all paths share: the last node that every path goes through becomes the root, what it wrote is done.

        So a token of any length keeps the lattice since that node only, and the result stays the exact one.
        """
        front = {(p, st) for p, states in paths.items() if p >= i for st in states}
        while len(front) > 1:
            node = max(front)
            before = paths[node[0]][node[1]][1]
            if before is None:
                return
            front.remove(node)
            front.add(before)
        p, state = front.pop()
        if paths[p][state][1] is None:
            return
        done.append(self._written(paths, (p, state)))
        for q in [q for q in paths if q < p]:
            del paths[q]
        paths[p] = {state: (paths[p][state][0], None, "")} if p < i else paths[p] | {state: (paths[p][state][0], None, "")}

    @staticmethod
    def _arcs(token: str, i: int) -> list[tuple[int, str, float]]:
        ch = token[i]
        arcs = [(1, x, SWAP) for x in LEET.get(ch, "")]
        if ch.isalpha():
            run = 1
            while i + run < len(token) and token[i + run] == ch:
                run += 1
            if run > 2:
                return [(run, ch, SHRINK), (run, ch * 2, SHRINK), (run, ch * run, KEEP)]
            arcs.append((1, ch, 0.0))
        elif ch in SEPARATORS:
            arcs += [(1, "", DROP), (1, " ", SPLIT)]
        elif ch in LEET:
            arcs.append((1, " ", KEEP))
        else:
            arcs.append((1, " ", SPLIT))
        return arcs


def obfuscated(core: str) -> bool:
    if core.isalpha():
        return len(core) > 3 and TRIPLE.search(core) is not None
    letters = sum(c.isalpha() or c in LEET for c in core)
    return 2 <= letters and len(core) - letters <= letters + 1 and not NUMBER.fullmatch(core) and not all(c in EDGE for c in core)


class Restorer:
    """Word forms with a bounded cache: the core of a token, and what the channel restores it to."""

    def __init__(self, model: CharModel, most: int = 300_000):
        self.model, self.most, self.cache = model, most, {}

    def __call__(self, token: str) -> tuple[str, ...]:
        found = self.cache.get(token)
        if found is None:
            token_ = TAIL.sub("", token)  # an ornament after the word
            core = token_.strip(EDGE)
            found = (core,) if core else ()
            for form in dict.fromkeys((core, token_.strip(ORNAMENT))):  # edges may be letters too
                if core and obfuscated(form):
                    found += tuple(self.model.decode(form).split())
            if len(self.cache) >= self.most:
                self.cache.clear()
            self.cache[token] = found
        return found

    def spaced(self, text: str) -> list[str]:
        """Words restored from runs of single characters with spaces between."""
        return [w for m in SPACED.finditer(text) for w in self.model.decode(m[0]).split() if len(w) > 2]


def features(word: str) -> tuple[str, ...]:
    """The whole word and its prefixes of three to six letters."""
    return (f"={word}", *(word[:k] for k in range(3, min(6, len(word)) + 1)))


def combined(weights: list[float]) -> float:
    """The strongest weight counts whole, the next two a quarter each."""
    best = sorted(weights, reverse=True)[:3]
    return float(sum(w if k == 0 else w / 4 for k, w in enumerate(best)))


def evidence(words, weights: dict[str, float]) -> float:
    return combined([max((weights.get(f, 0.0) for f in features(w)), default=0.0) for w in words])


def fit(rows: list[tuple[str, int]], restorer: Restorer, support: int = 4) -> dict[str, float]:
    """Feature weights, and the logistic curve's two numbers under "a" and "b" with a leading NUL."""
    n = [sum(1 - y for _, y in rows), sum(y for _, y in rows)]
    docs = []
    for text, y in rows:
        low = text.lower()
        docs.append(({w for t in set(low.split()) for w in restorer(t)} | set(restorer.spaced(low)), y))
    toxic = Counter(f for words, y in docs if y for f in {f for w in words for f in features(w)})
    toxic = Counter({f: t for f, t in toxic.items() if t >= support})
    own: dict[str, tuple] = {}

    def wanted(word: str) -> tuple:
        if word not in own:
            own[word] = tuple(f for f in features(word) if f in toxic)
        return own[word]

    clean = Counter(f for words, y in docs if not y for f in {f for w in words for f in wanted(w)})
    weights = {f: math.log((t + 0.5) / (n[1] + 1)) - math.log((clean[f] + 0.5) / (n[0] + 1)) for f, t in toxic.items()} if min(n) > 0 else {}
    weights = {f: w for f, w in weights.items() if w >= 3.0}
    contexts: dict[str, set] = defaultdict(set)
    for text, y in rows:
        before = ""
        for t in text.lower().split() if y else ():
            for w in restorer(t):
                for f in wanted(w):
                    if f in weights:
                        contexts[f].add(before)
            before = t
    weights = {f: w for f, w in weights.items() if len(contexts[f]) >= support}
    x = np.array([evidence(w, weights) for w, _ in docs], np.float64)
    y = np.array([y for _, y in docs], np.float64)
    a, b = 0.0, -1.0
    if min(n) > 0:
        design, theta = np.stack([x, np.ones_like(x)], 1), np.array([0.0, -1.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-2])
            step = np.linalg.solve(hess, design.T @ (y - p) - 1e-2 * theta)
            theta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        a, b = theta.tolist()
    return weights | {"\0a": a, "\0b": b}


class Scorer:
    def __init__(self, log: np.ndarray, weights: dict[str, float], most: int = 400_000):
        model = CharModel.__new__(CharModel)
        model.log = log
        self.restorer, self.weights, self.most = Restorer(model, 1000), weights, most
        self.a, self.b = weights["\0a"], weights["\0b"]
        self.known: dict[str, float] = {}

    def weight(self, token: str) -> float:
        return max((self.weights.get(f, 0.0) for w in self.restorer(token) for f in features(w)), default=0.0)

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        tokens, known = set(low.split()), self.known
        if len(known) > self.most:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = self.weight(t)
        hits = [w for w in map(known.__getitem__, tokens) if w]
        for w in self.restorer.spaced(low):
            hits.append(max((self.weights.get(f, 0.0) for f in features(w)), default=0.0))
        e = combined(hits)
        return 1 / (1 + math.exp(-min(max(self.a * e + self.b, -30), 30)))


def train(docs: DataFrame, labels: DataFrame, held_out, max_toxic: int = 2500, max_clean: int = 4000) -> tuple[np.ndarray, dict[str, float]]:
    """The character model's log table and the classifier's weights, from rows (doc_id, text) that are not held out."""
    learn = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")

    def count(batches):
        counts = np.zeros(SIZE**3, np.int64)
        for b in batches:
            count_trigrams([t for t in b.column("text").to_pylist() if t], counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["code", "n"])

    counted = learn.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3, np.int64)  # at most SIZE**3 rows come here
    counts[counted.column("code").to_numpy()] = counted.column("n").to_numpy()
    log = CharModel(counts).log

    known = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = learn.join(F.broadcast(pick(1, max_toxic).unionByName(pick(0, max_clean))), "doc_id")  # max_toxic + max_clean small rows

    def fit_all(batches):
        model = CharModel.__new__(CharModel)
        model.log = log
        rows = sorted((i, t or "", y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
        found = fit([(t, y) for _, t, y in rows], Restorer(model))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.float64())], ["feature", "weight"])

    fitted = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(1).mapInArrow(fit_all, "feature string, weight double").toArrow()
    weights = dict(zip(fitted.column("feature").to_pylist(), fitted.column("weight").to_pylist(), strict=True))
    return log, weights or {"\0a": 0.0, "\0b": -1.0}


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, held_out):
    return train(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), labels, held_out)


def held_out_third(doc_id):
    return crc_mod(doc_id, 3) == 1


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=held_out_third) -> DataFrame:
    """(doc_id, held_out, score) for every row of df; no held-out row is learnt from."""
    spark = df.sparkSession
    log, weights = _model(df, labels, id_col, text_col, held_out)
    shared = spark.sparkContext.broadcast((log, weights))  # 1 MB of table and the weights of a bounded sample's words

    def run(batch: pa.RecordBatch, scorer: Scorer):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([scorer.score(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double", lambda: Scorer(*shared.value))


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, held_out=held_out_third) -> DataFrame:
    """df without the rows that score at least threshold; all columns stay."""
    log, weights = _model(df, labels, id_col, text_col, held_out)
    shared = df.sparkSession.sparkContext.broadcast((log, weights))

    def run(batch: pa.RecordBatch, scorer: Scorer):
        return batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(text_col).to_pylist()]))

    return map_batches(df, run, df.schema, lambda: Scorer(*shared.value))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document's score; 1 is predicted from 0.7 on."""
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
