"""Language identification by a byte convolutional network.

A text's UTF-8 bytes (ASCII capitals folded, digits and signs merged) are cut
into windows of a fixed length that cover all of it. Byte embeddings go through
filters of several widths, a rectifier, a maximum over the window, and a softmax
layer. The network is trained with numpy on windows of a bounded sample of
labelled rows (``sample`` ids, least hash of the id first, one row an id, and of each at most ``per_row`` windows spread over
its length, so that long texts do not outweigh others). For prediction, the
embedding and each filter are folded into tables over single bytes and byte
pairs, so that a window needs table look-ups and sums only. A text's language is
the one with the highest probability averaged over its windows, by length.

Null texts and texts without a letter are ``und`` with score 0; so is every text
when no labelled row may be learnt from. Of equally likely languages the first by name
wins. A text may have any length: all its windows count, in batches of bounded size. Rows of unknown language, repeated rows
and null ids are predicted like others; of an id's rows the first by text and language is learnt from. An empty table gives an empty
result; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, table

LETTER = re.compile(r"[^\W\d_]")
WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8


def _byte_classes() -> np.ndarray:
    """0 pads; letters a-z, white space, other ASCII; bytes from 128 on stay apart."""
    out = np.zeros(256, np.uint8)
    for b in range(128):
        ch = chr(b).lower()
        out[b] = ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isspace() else 28
    out[128:245] = np.arange(29, 146)
    return out


BYTES = _byte_classes()
SYMBOLS = 146


def windows_of(text: str) -> np.ndarray:
    """Rows of WINDOW byte classes that cover the text; the last is padded."""
    data = BYTES[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros((n, WINDOW), np.uint8)
    out.reshape(-1)[: len(data)] = data
    return out


class Network:
    """Weights: E (symbols x dim), W[w] (w x dim x filters), c[w] (filters), V (features x classes), b (classes)."""

    def __init__(self, n_classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, 0.3, (SYMBOLS, DIM)), "V": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_classes)), "b": np.zeros(n_classes)}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS))
            self.p[f"c{w}"] = np.zeros(FILTERS)

    def maxima(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Features before the rectifier and where each maximum lies."""
        feats, where = [], []
        for w in WIDTHS:
            tables = [(self.p["E"] @ self.p[f"W{w}"][j]).astype(np.float32) for j in range(w)]
            h = tables[0][x[:, : WINDOW - w + 1]]
            for j in range(1, w):
                h += tables[j][x[:, j : WINDOW - w + 1 + j]]
            at = h.argmax(axis=1)
            where.append(at)
            feats.append(np.take_along_axis(h, at[:, None], 1)[:, 0] + self.p[f"c{w}"])
        return np.concatenate(feats, 1), where

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        raw, where = self.maxima(x)
        f = np.maximum(raw, 0)
        z = f @ self.p["V"] + self.p["b"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        d = p * (weight / len(y))[:, None]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["V"], g["b"] = f.T @ d, d.sum(0)
        back = (d @ self.p["V"].T) * (raw > 0)
        rows = np.arange(len(y))[:, None]
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"c{w}"] = own.sum(0)
            for j in range(w):
                sym = x[rows, where[k] + j]  # (windows, filters)
                e = self.p["E"][sym]
                g[f"W{w}"][j] = np.einsum("nf,nfd->df", own, e)
                np.add.at(g["E"], sym, own[:, :, None] * self.p[f"W{w}"][j].T[None])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> None:
        rng, share = np.random.default_rng(seed), np.bincount(y, minlength=self.p["V"].shape[1])
        weight = (len(y) / (np.count_nonzero(share) * np.maximum(share, 1)))[y]
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                pick, t = order[at : at + batch], t + 1
                for k, g in self.gradients(x[pick], y[pick], weight[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


class Predictor:
    """A trained network folded into tables over single bytes and byte pairs."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.V, self.b = p["V"].astype(np.float32), p["b"].astype(np.float32)
        self.c = np.concatenate([p[f"c{w}"] for w in WIDTHS]).astype(np.float32)
        self.tables = {}
        for w in WIDTHS:
            single = [(p["E"] @ p[f"W{w}"][j]).astype(np.float32) for j in range(w)]
            self.tables[w] = [(j, (single[j][:, None] + single[j + 1][None]).reshape(-1, FILTERS), True) if j + 1 < w else (j, single[j], False) for j in range(0, w, 2)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.b)), np.float32)
        for at in range(0, len(x), 256):
            s = x[at : at + 256].astype(np.int32)
            pairs = s[:, :-1] * SYMBOLS + s[:, 1:]
            feats = []
            for w in WIDTHS:
                n, h = WINDOW - w + 1, None
                for j, t, pair in self.tables[w]:
                    part = np.take(t, (pairs if pair else s)[:, j : j + n], axis=0)
                    h = part if h is None else np.add(h, part, out=h)
                feats.append(h.max(axis=1))
            z = np.maximum(np.concatenate(feats, 1) + self.c, 0) @ self.V + self.b
            e = np.exp(z - z.max(1, keepdims=True))
            out[at : at + 256] = e / e.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[str | None], classes: list[str]) -> list[tuple[str, float]]:
        held, owner, size = [], [], []
        for i, t in enumerate(texts):
            if t and classes and LETTER.search(t):
                x = windows_of(t)
                held.append(x)
                owner += [i] * len(x)
                size.append(np.count_nonzero(x, axis=1))
        out = [("und", 0.0)] * len(texts)
        if held:
            p = self.probabilities(np.concatenate(held)) * np.concatenate(size)[:, None]
            owner = np.array(owner)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            sums = np.add.reduceat(p.astype(np.float64), first, axis=0)
            sums /= sums.sum(1, keepdims=True)
            for i, s in zip(owner[first].tolist(), sums, strict=True):
                out[i] = (classes[int(s.argmax())], min(1.0, float(s.max())))
        return out


def held_out_third(doc_id):
    return crc_mod(doc_id, 3) == 1


def train(rows: DataFrame, sample: int, per_row: int = 4) -> tuple[list[str], dict[str, np.ndarray]]:
    """Learns from rows (doc_id, text, lang): at most sample rows, and of each at most per_row windows over its length."""
    known = rows.where("lang is not null and text is not null and doc_id is not null")
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def cut(batch: pa.RecordBatch):
        out = []
        for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if LETTER.search(t):
                x = windows_of(t)
                for i in sorted({int(k) for k in np.linspace(0, len(x) - 1, per_row)}):
                    out.append((lang, x[i].tobytes()))
        return pa.RecordBatch.from_pydict({"lang": [r[0] for r in out], "x": pa.array([r[1] for r in out], pa.binary())}) if out else None

    got = map_batches(known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).select("x.text", "x.lang"), cut, "lang string, x binary").toArrow()  # sample * per_row * WINDOW bytes at most
    pairs = sorted(zip(got.column("lang").to_pylist(), got.column("x").to_pylist(), strict=True))
    classes = sorted({lang for lang, _ in pairs})
    network = Network(len(classes))
    if classes:
        number = {c: i for i, c in enumerate(classes)}
        network.train(np.frombuffer(b"".join(x for _, x in pairs), np.uint8).reshape(-1, WINDOW), np.array([number[lang] for lang, _ in pairs]))
    return classes, network.p


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=held_out_third, sample: int = 3000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of df."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    classes, p = train(rows.where(~F.col("held_out")).select("doc_id", "text", "lang"), sample)
    shared = df.sparkSession.sparkContext.broadcast(p)

    def run(batch: pa.RecordBatch, predictor: Predictor):
        texts, found = batch.column("text"), []
        for at in range(0, batch.num_rows, 512):
            found += predictor.predict(texts.slice(at, 512).to_pylist(), classes)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(rows.select("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double", lambda: Predictor(shared.value))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document's language."""
    return identify(table(spark, sf_dir, "documents"))
