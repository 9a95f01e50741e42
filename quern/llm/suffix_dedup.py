"""Removal of repeated byte strings by longest previous factors over suffixes sorted in buckets.

Every byte covered by a string of L bytes that also starts in a document with a
smaller id is removed. The suffixes that could have such a match are found and
sorted without sorting the whole corpus:

1. Winnowing: in each window of L bytes the first smallest hash of its G-byte
   grams is an anchor, so two equal windows have the same anchor at the same
   place. For each anchor its hash and hashes of what stands around it are dealt
   into buckets by the anchor's hash (arrays, not rows).
2. A bucket is a sparse suffix order of its anchors: they are sorted by
   fingerprints of all around them (every window that holds the anchor), then by
   document. Neighbours of one fingerprint share SIDE + L bytes; the previous
   place with a smaller document gives the earlier match, and the anchor goes
   with all around it. What is first seen here, but shares a side with another
   document's, is open.
3. The surroundings of open anchors are sent to their bucket as bytes. There the
   suffixes that start in them are put in suffix order by prefix doubling up to
   L bytes, equal ones by document, with the common prefix of neighbours. A
   suffix's longest previous factor is the greater of the least common prefixes
   up to the previous and to the next place of a smaller document; where it has L
   bytes, the string goes.
4. Each document unites its removed ranges.

In step 2 surroundings are equal if 48 bits of the anchor's hash and 64 of a hash of
it and all around it are; the sides' 24 bits only open anchors, whose bytes step 3
compares. A run of one byte has one anchor for all its equal surroundings, and
what goes there goes for the whole run.

Null and empty texts and those under L bytes keep all; a text may have any length (it
is cut in pieces of BLOCK windows). Rows without an id are no source and keep all;
rows of the same id are not earlier than each other, so ties and repeated rows
lose nothing to themselves and all the same to smaller ids; an empty table gives
an empty result; columns other than the two named are left aside, whatever
their names. A group of copies is never compared pairwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parts, table

L, G = 50, 20
SIDE = L - G  # bytes to each side of an anchor that a window can reach
HALF = SIDE // 2
PAD = 96
BLOCK = 1 << 20
SPREAD = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = {w: np.uint64(pow(0x9E3779B97F4A7C15, 2 * w + 1, 2**64)) for w in (1, 2, 4, 8, 16)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """Per block of texts: (text number, position, anchor hash, surroundings, left half, right half).

    A text longer than BLOCK is taken in pieces of BLOCK windows, each with all bytes its anchors' surroundings reach; an
    anchor of windows in two pieces comes twice, which changes no result.
    """
    out, held, size = [], [], 0
    for k, t in enumerate(texts):
        for lo in range(0, len(t) - L + 1, BLOCK):
            held.append((k, lo))
            size += min(len(t) - lo, BLOCK) + PAD
            if size >= BLOCK:
                out.append(_anchors(texts, held))
                held, size = [], 0
    if held:
        out.append(_anchors(texts, held))
    return out


def _anchors(texts: list[bytes], pieces: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Anchors of the windows that start in BLOCK bytes from each (text number, first window)."""
    gap = bytes(PAD)
    number, first = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    whole = np.array([len(texts[k]) for k in number.tolist()], np.int64)
    begin, stop = np.maximum(first - SIDE - 1, 0), np.minimum(first + BLOCK - 1 + SIDE + L, whole)
    data = np.frombuffer(gap + b"".join(texts[k][x:y] + gap for k, x, y in zip(number.tolist(), begin.tolist(), stop.tolist(), strict=True)), np.uint8)
    starts = PAD + np.concatenate([[0], np.cumsum(stop - begin + PAD)[:-1]])
    h = {1: SPREAD[data]}
    for w in (1, 2, 4, 8):
        x = h[w]
        h[2 * w] = x[:-w] * STEP[w] + x[w:]
    n = len(data) - 3 * 16
    gram = _mix(h[16][:n] * STEP[4] + h[4][16 : 16 + n])
    key = (gram & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)  # a block stays below 2**24 bytes
    low = key
    for w in (1, 2, 4, 8):
        low = np.minimum(low[:-w], low[w:])
    reach = SIDE + 1 - 16
    low = np.minimum(low[:-reach], low[reach:])  # least of SIDE + 1 grams
    valid = np.zeros(len(data) + 1, np.int32)
    windows = starts + first - begin
    np.add.at(valid, windows, 1)
    np.add.at(valid, windows + np.minimum(whole - first - L + 1, BLOCK), -1)
    inside = np.cumsum(valid)[: len(low)] > 0
    at = low[inside] & np.uint64((1 << 24) - 1)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])].astype(np.int64) if len(at) else at.astype(np.int64)
    doc = np.searchsorted(starts, at, side="right") - 1
    pos = at - starts[doc] + begin[doc]
    left, right = np.minimum(pos, SIDE), np.minimum(whole[doc] - pos, L)
    a = gram[at]
    h16 = h[16]
    # What lies beyond a text's end is the gap of zeros; the clipped sizes tell it from zeros of a text.
    lo = _mix(h16[at - HALF] + STEP[8] * np.minimum(left, HALF).astype(np.uint64))
    hi = _mix(h16[at + G - 1] + STEP[16] * np.minimum(right, G + HALF).astype(np.uint64))
    around = _mix(_mix(h16[at - SIDE] + _mix(h16[at - 16]) * STEP[1]) + _mix(h16[at + G]) * STEP[4] + _mix(h16[at + L - 16]) * STEP[8] + (left * 64 + right).astype(np.uint64) * STEP[2] + a * STEP[16])
    # A run of one byte has the same all around each anchor but at its ends: the first stands for all.
    same = np.maximum.accumulate(np.where(np.concatenate([[True], data[1:] != data[:-1]]), np.arange(len(data)), 0))
    first_of = ~((pos > SIDE) & (pos + L <= whole[doc]) & (same[at + L - 1] < at - SIDE))
    if not first_of.all():
        doc, pos, a, around, lo, hi = (x[first_of] for x in (doc, pos, a, around, lo, hi))
    return number[doc], pos, a, around, lo, hi


def top(x: np.ndarray, n: int) -> bytes:
    """The n highest bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - n :]).tobytes()


def from_top(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, 8 - n :] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def six(x: np.ndarray) -> bytes:
    return top(x, 6)


def from_six(b: bytes) -> np.ndarray:
    return from_top(b, 6)


def squeeze(x: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed byte planes of their differences."""
    x = np.diff(x.astype(kind), prepend=np.zeros(1, kind))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def expand(b: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


DEALT = "bucket int, batch long, keys binary, docs binary, ids binary, runs binary, pos binary, a binary, c binary, l binary, r binary"
DEALT_NAMES = [x.split()[0] for x in DEALT.split(", ")]
DEALT_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 9]


def _rows(rows: list[dict], names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)


def _deal(buckets: int):
    def run(batches):
        batch = TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo in range(0, whole.num_rows, 4000):
                b = whole.slice(lo, 4000)
                texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_numpy()
                found = anchors(texts)
                if found:
                    doc, pos, a, c, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
                    k = ((a >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(k, kind="stable")
                    cuts = np.searchsorted(k[order], np.arange(buckets + 1))
                    out = [{"bucket": int(batch % buckets), "batch": batch, "keys": b.column("rk").to_numpy().tobytes()}]
                    for n in np.flatnonzero(np.diff(cuts)).tolist():
                        s = order[cuts[n] : cuts[n + 1]]
                        first = np.flatnonzero(np.diff(doc[s], prepend=-1))
                        runs = np.diff(np.append(first, len(s)))
                        d = doc[s][first]
                        out.append({"bucket": n, "batch": batch, "docs": squeeze(d, "<i4"), "ids": squeeze(ids[d], "<i8"), "runs": squeeze(runs, "<i4"), "pos": squeeze(pos[s], "<i4"), "a": six(a[s]), "c": top(c[s], 8), "l": top(left[s], 3), "r": top(right[s], 3)})
                    yield _rows(out, DEALT_NAMES, DEALT_TYPES)
                batch += 1

    return run


def _first_doc(order: np.ndarray, keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order (sorted by keys, then doc): the least and the greatest doc of each row's group, in the rows' own order."""
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    least, most = np.empty(len(order), doc.dtype), np.empty(len(order), doc.dtype)
    least[order] = np.repeat(doc[order][start], size)
    most[order] = np.repeat(doc[order][start + size - 1], size)
    return least, most


def _reach(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """The least common prefix from each place of a suffix order up to the previous place of a smaller document; 0 if under least.

    Each place looks at the one before it and, where that is no smaller, goes on from where that one has got to: all between
    are no smaller either. All places do so at once, so that chains shorten by halves.
    """
    low, at = np.where(lcp >= least, lcp, 0), np.arange(-1, len(doc) - 1)
    todo = np.flatnonzero(low)
    todo = todo[doc[at[todo]] >= doc[todo]]
    while len(todo):
        before = at[todo]
        low[todo], at[todo] = np.minimum(low[todo], low[before]), at[before]
        todo = todo[low[todo] > 0]
        todo = todo[doc[at[todo]] >= doc[todo]]
    return low


def previous_factors(doc: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest previous factor of each place of a suffix order: the document it starts in is smaller. Those under least are 0.

    doc: the place's document; lcp: the common prefix with the place before (0 at the first).
    """
    after = np.append(lcp[1:], 0)
    return np.maximum(_reach(doc, lcp, least), _reach(doc[::-1], after[::-1], least)[::-1])


def judge(a, c, left, right, doc) -> tuple[np.ndarray, np.ndarray]:
    """(gone, open) for the anchors of a bucket.

    Of equal surroundings only those in their first document remain, and these are open if other surroundings that
    remain share a half with them: whatever a later copy could match, its first document matches too.
    """
    order = np.lexsort((doc, c, a))
    same = np.zeros(len(order), np.int64)
    same[1:] = ((a[order][1:] == a[order][:-1]) & (c[order][1:] == c[order][:-1])) * (SIDE + L)
    gone = np.zeros(len(a), bool)
    gone[order] = previous_factors(doc[order], same, SIDE + L) > 0
    rest = np.flatnonzero(~gone)
    other = np.zeros(len(a), bool)
    a, doc = a[rest], doc[rest]
    for half in (left[rest], right[rest]):
        order = np.lexsort((doc, half, a))
        low, high = _first_doc(order, [a, half], doc)
        other[rest] |= low != high
    return gone, other


ANSWER = "batch long, keys binary, docs binary, pos binary, a binary"
ANSWER_NAMES, ANSWER_TYPES = ["batch", "keys", "docs", "pos", "a"], [pa.int64(), *[pa.binary()] * 4]


def _by_key(batches, key: str, columns: list[str]):
    """(key, rows) for runs of equal keys."""
    held, now = [], None
    for b in batches:
        for k, *rest in zip(*(b.column(x).to_pylist() for x in (key, *columns)), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(rest)
    if held:
        yield now, held


def _judge_buckets(batches):
    """Answers by batch: docs (negative-complemented where open), positions, and the anchors of the open ones."""
    for _, rows in _by_key(batches, "bucket", DEALT_NAMES[1:]):
        out = [{"batch": r[0], "keys": r[1]} for r in rows if r[1] is not None]
        rows = [r for r in rows if r[1] is None]
        if rows:
            docs, ids, runs, pos = ([expand(r[i], t) for r in rows] for i, t in ((2, "<i4"), (3, "<i8"), (4, "<i4"), (5, "<i4")))
            a = [from_six(r[6]) for r in rows]
            gone, is_open = judge(np.concatenate(a), *(np.concatenate([from_top(r[i], w) for r in rows]) for i, w in ((7, 8), (8, 3), (9, 3))), np.concatenate([np.repeat(x, n) for x, n in zip(ids, runs, strict=True)]))
            at = 0
            for r, d, n, p, x in zip(rows, docs, runs, pos, a, strict=True):
                g, o = gone[at : at + len(p)], is_open[at : at + len(p)]
                at += len(p)
                keep = g | o
                if keep.any():
                    who = np.repeat(d, n)
                    out.append({"batch": r[0], "docs": np.where(o, ~who, who)[keep].astype("<i4").tobytes(), "pos": p[keep].tobytes(), "a": six(x[o])})
        if out:
            yield _rows(out, ANSWER_NAMES, ANSWER_TYPES)


def _to_documents(batches):
    """One row for each document with anchors gone or open."""
    for _, rows in _by_key(batches, "batch", ["keys", "docs", "pos", "a"]):
        keys = next((np.frombuffer(r[0], "<i8") for r in rows if r[0] is not None), None)
        rows = [r for r in rows if r[0] is None]
        if not rows:
            continue
        doc = np.concatenate([np.frombuffer(r[1], "<i4") for r in rows])
        pos = np.concatenate([np.frombuffer(r[2], "<i4") for r in rows])
        a = np.zeros(len(doc), np.uint64)
        a[doc < 0] = np.concatenate([from_six(r[3]) for r in rows])
        is_open, who = doc < 0, np.where(doc < 0, ~doc, doc)
        order = np.argsort(who, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(who[order], prepend=-1)), len(order))
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s = order[lo:hi]
            o = s[is_open[s]]
            out.append((int(keys[who[s[0]]]), np.sort(pos[s[~is_open[s]]]).tobytes(), pos[o].tobytes(), six(a[o])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3))], ["rk", "gone", "open", "a"])


CARRIED = "rk long, doc_id long, text binary, gone binary, bucket int, pos binary, a binary, around binary, clip binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
CARRIED_NAMES = [x.split()[0] for x in CARRIED.split(", ")]
CARRIED_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3, pa.string()]


def finish(text: bytes, gone: np.ndarray, starts: np.ndarray) -> dict:
    """The result of a text from anchors gone with all around them, and starts of repeated strings."""
    n = len(text)
    data, delta = np.frombuffer(text, np.uint8), np.zeros(n + 1, np.int32)
    lo = np.concatenate([np.maximum(gone - SIDE, 0), starts]).astype(np.int64)
    hi = np.concatenate([np.minimum(gone + L, n), starts + L]).astype(np.int64)
    if len(lo) and n > SIDE + L:  # in a run of one byte one anchor stands for all
        first = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))
        end = np.append(first[1:], n)
        long = end - first > SIDE + L
        if long.any():
            first, end = first[long], end[long]
            run = np.searchsorted(first, lo, side="right") - 1
            inside = (run >= 0) & (hi <= end[run])
            hi[inside] = end[run][inside]
    np.add.at(delta, lo, 1)
    np.add.at(delta, hi, -1)
    mask = np.cumsum(delta[:n]) > 0
    spans = int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())
    kept = text if not spans else data[~mask].tobytes()
    return {"n_bytes": n, "n_removed": int(mask.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def _open_contexts(buckets: int):
    """Documents with their answers (rows of one key, answers first): finished ones, and open ones with the surroundings of their open anchors."""

    def run(batches):
        out, contexts = [], []
        size = 0

        def flush():
            nonlocal size
            rows = list(out)
            if contexts:
                key, doc, pos, a, around, clip = (np.concatenate(x) for x in zip(*contexts, strict=True))
                k = ((a >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
                for n in np.unique(k).tolist():
                    s = np.flatnonzero(k == n)
                    rows.append({"bucket": n, "rk": None, "pos": np.stack([key[s], doc[s], pos[s].astype(np.int64)]).tobytes(), "a": six(a[s]), "around": around[s].tobytes(), "clip": clip[s].tobytes()})
            out.clear()
            contexts.clear()
            size = 0
            return _rows(rows, CARRIED_NAMES, CARRIED_TYPES)

        for key, rows in _by_key(batches, "rk", ["doc_id", "text", "gone", "open", "a"]):
            answers = [r for r in rows if r[1] is None]
            gone = np.concatenate([np.frombuffer(r[2], "<i4") for r in answers] or [np.zeros(0, np.int32)])
            pos = np.concatenate([np.frombuffer(r[3], "<i4") for r in answers] or [np.zeros(0, np.int32)]).astype(np.int64)
            texts = [r for r in rows if r[1] is not None]
            for doc_id, text, *_ in texts:
                if len(pos):
                    out.append({"rk": key, "doc_id": doc_id, "text": text, "gone": gone.astype("<i4").tobytes()})
                    size += len(text)
                else:
                    out.append({"rk": key, "doc_id": doc_id, **finish(text, gone, np.zeros(0, np.int64))})
            if len(pos):
                doc_id, text = texts[0][0], texts[0][1]
                a = np.concatenate([from_six(r[4]) for r in answers])
                data = np.frombuffer(bytes(SIDE) + text + bytes(L), np.uint8)
                for lo in range(0, len(pos), 50_000):
                    p = pos[lo : lo + 50_000]
                    around = data[p[:, None] + np.arange(SIDE + L)]
                    clip = np.stack([SIDE - np.minimum(p, SIDE), SIDE + np.minimum(len(text) - p, L)], 1).astype(np.uint8)
                    contexts.append((np.full(len(p), key), np.full(len(p), doc_id), p, a[lo : lo + 50_000], around, clip))
                    size += around.size
                    if size > 8_000_000:
                        yield flush()
            if size > 8_000_000 or len(out) > 5000:
                yield flush()
        if out or contexts:
            yield flush()

    return run


class Suffixes:
    """The L-byte suffixes that start at the first SIDE + 1 places of rows of SIDE + L bytes, ranked by prefix doubling."""

    def __init__(self, around: np.ndarray):
        n, width = around.shape
        padded = np.concatenate([around, np.zeros((n, 8), np.uint8)], axis=1)
        self.eight = np.zeros((n, width + 1), np.uint64)  # eight bytes from each place, the first the highest
        for j in range(8):
            self.eight = (self.eight << np.uint64(8)) | padded[:, j : j + width + 1].astype(np.uint64)

        def dense(x: np.ndarray) -> np.ndarray:
            return np.unique(x.ravel(), return_inverse=True)[1].reshape(x.shape).astype(np.uint64)

        def double(r: np.ndarray, by: int, places: int) -> np.ndarray:
            return dense((r[:, :places] << np.uint64(32)) | r[:, by : by + places])

        self.rank = {8: dense(self.eight[:, : width - 7])}
        self.rank[16] = double(self.rank[8], 8, width - 15)
        self.rank[32] = double(self.rank[16], 16, width - 31)
        self.rank[L] = double(self.rank[32], L - 32, width - L + 1)

    def order(self, i: np.ndarray, j: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The suffixes (row i, place j) in suffix order, equal ones by document."""
        return np.lexsort((doc, self.rank[L][i, j]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common prefix, at most L, of each suffix (row i, place j) with the one before; 0 at the first."""
        out = np.zeros(len(i), np.int64)
        whole = self.rank[L][i, j]
        out[1:][whole[1:] == whole[:-1]] = L
        at = np.flatnonzero(out[1:] == 0) + 1
        (i, p), (j, q) = (i[at], i[at - 1]), (j[at], j[at - 1])
        size = np.zeros(len(at), np.int64)
        for w in (32, 16, 8):
            known = size + w < L
            same = self.rank[w][i, np.where(known, j + size, 0)] == self.rank[w][p, np.where(known, q + size, 0)]
            size += w * (known & same)
        x = self.eight[i, j + size] ^ self.eight[p, q + size]
        for k in range(7):
            size += x >> np.uint64(56 - 8 * k) == 0
        out[at] = np.minimum(size + (x == 0), L)
        return out


def repeated(around: np.ndarray, clip: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the suffixes whose longest previous factor has L bytes; clip: each row's bytes that belong to its text."""
    place = np.arange(SIDE + 1)
    i, j = np.nonzero((place >= clip[:, :1]) & (place + L <= clip[:, 1:]))
    if not len(i):
        return i, j
    suffixes = Suffixes(around)
    order = suffixes.order(i, j, doc[i])
    i, j = i[order], j[order]
    hit = previous_factors(doc[i], suffixes.common(i, j), L) >= L
    return i[hit], j[hit]


def _sort_suffixes(batches):
    """(rk, starts) of repeated strings, from the surroundings in each bucket."""
    for _, rows in _by_key(batches, "bucket", ["pos", "around", "clip"]):
        key, doc, pos = (np.concatenate(x) for x in zip(*(np.frombuffer(r[0], np.int64).reshape(3, -1) for r in rows), strict=True))
        around = np.concatenate([np.frombuffer(r[1], np.uint8).reshape(-1, SIDE + L) for r in rows])
        clip = np.concatenate([np.frombuffer(r[2], np.uint8).reshape(-1, 2) for r in rows]).astype(np.int64)
        i, j = repeated(around, clip, doc)
        start = pos[i] - SIDE + j
        if not len(i):
            continue
        order = np.argsort(key[i], kind="stable")
        who = key[i][order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])), len(who))
        yield pa.RecordBatch.from_arrays([pa.array(who[cuts[:-1]]), pa.array([np.unique(start[order[x:y]]).astype("<i4").tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["rk", "starts"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish_open(batches):
    out = []
    for _, rows in _by_key(batches, "rk", ["doc_id", "text", "gone", "starts"]):
        starts = np.concatenate([np.frombuffer(r[3], "<i4") for r in rows if r[3] is not None] or [np.zeros(0, np.int32)]).astype(np.int64)
        out += [{"doc_id": d, **finish(t, np.frombuffer(g, "<i4").astype(np.int64), starts)} for d, t, g, _ in rows if t is not None]
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, FINAL)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, FINAL)


FINAL = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of df."""
    spark, scratch, n = df.sparkSession, Scratch(df.sparkSession, "suffix"), parts(df.sparkSession)
    buckets = 4 * n
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("rk", F.xxhash64("doc_id", "text"))
    dealt = rows.where("doc_id is not null").mapInArrow(_deal(buckets), DEALT)
    judged = dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_judge_buckets, ANSWER)
    answers = scratch.write(judged.repartition(n, "batch").sortWithinPartitions("batch").mapInArrow(_to_documents, "rk long, gone binary, open binary, a binary"))
    none = lambda c: F.lit(None).cast("binary").alias(c)
    texts = rows.select("rk", "doc_id", "text", none("gone"), none("open"), none("a"), F.lit(1).alias("kind"))
    both = answers.select("rk", F.lit(None).cast("long").alias("doc_id"), none("text"), "gone", "open", "a", F.lit(0).alias("kind")).unionByName(texts)
    carried = scratch.write(both.repartition(n, "rk").sortWithinPartitions("rk", "kind").drop("kind").mapInArrow(_open_contexts(buckets), CARRIED))
    scratch.drop(answers)
    contexts = carried.where("bucket is not null").select("bucket", "pos", "around", "clip")
    found = contexts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_suffixes, "rk long, starts binary")
    waiting = carried.where("text is not null").select("rk", "doc_id", "text", "gone", none("starts"))
    rest = found.select("rk", F.lit(None).cast("long").alias("doc_id"), none("text"), none("gone"), "starts").unionByName(waiting)
    finished = rest.repartition(n, "rk").sortWithinPartitions("rk").mapInArrow(_finish_open, RESULT)
    return finished.unionByName(carried.where("kept_sha256 is not null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document without its repeated strings."""
    return remove_repeats(table(spark, sf_dir, "documents"))
