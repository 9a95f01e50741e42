"""Secret scan by a trigram inverted index and Boolean trigram queries.

Every rule's regular expression is parsed and turned into a Boolean query over
byte trigrams (A-Z lower-cased) that any match must hold: AND of the trigrams of a
mandatory literal, OR over alternatives. Texts are indexed in segments of at
most SEGMENT bytes: one pass over a segment's trigrams gives the posting lists of
all that the rules ask for. A query is answered by intersecting and
uniting lists, and only candidates are verified with the rule itself. Rules
without a mandatory trigram (runs of hex digits) scan every document. Nothing is
shuffled; a text longer than a segment is a segment of its own, whole.

Null texts count as empty; empty texts give no span; of spans that start at one
place the rule listed first comes first; a text that holds a span twice gives
both; repeated rows and repeated ids give a result each; an empty table gives an
empty result; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

ALL = ("all",)
SEGMENT = 8 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters that the group must have
    base: bool = False


#: The base kinds in the order that breaks ties, then the kinds that this scan adds.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _and(*qs):
    parts = {p for q in qs if q != ALL for p in (q[1] if q[0] == "and" else (q,))}
    return ALL if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _or(qs):
    qs = set(qs)
    if not qs or ALL in qs:
        return ALL
    need = lambda q: q[1] if q[0] == "and" else frozenset((q,))
    least = {q for q in qs if not any(o != q and need(o) < need(q) for o in qs)}  # a weaker one makes a stronger one idle
    return next(iter(least)) if len(least) == 1 else ("or", frozenset(least))


def _fold(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased; the index and the queries fold alike."""
    return text.encode("utf-8", "replace").lower()


def _strings(exact) -> tuple:
    return _or(_and(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) for s in exact)


def _walk(tree, flags: int, most: int = 64):
    """(the exact byte strings that a tree can match, folded, or None; the query that every match satisfies)."""
    run, query, broken = {b""}, ALL, False
    for op, arg in tree:
        exact, q = _node(op, arg, flags, most)
        if exact is not None and len(run) * len(exact) <= most:
            run = {a + b for a in run for b in exact}
            continue
        query, broken = _and(query, _strings(run), q), True
        run = set(exact) if exact is not None else {b""}
    return (None, _and(query, _strings(run))) if broken else (run, ALL)


def _letter(code: int, flags: int) -> set[bytes] | None:
    """A character as the index holds it; None where other letters than its ASCII capital may stand for it."""
    if flags & re.IGNORECASE and (code > 127 or not flags & re.ASCII and chr(code) in "iIkKsS"):
        return None
    return {_fold(chr(code))}


def _node(op, arg, flags: int, most: int):
    if op is sre.LITERAL:
        return _letter(arg, flags), ALL
    if op is sre.AT:
        return {b""}, ALL
    if op is sre.IN:
        chars: set = set()
        for kind, value in arg:
            codes = [value] if kind is sre.LITERAL else range(value[0], value[1] + 1) if kind is sre.RANGE and value[1] - value[0] < 8 else None
            each = [_letter(c, flags) for c in codes] if codes else [None]
            if any(x is None for x in each):
                return None, ALL
            chars.update(*each)
        return (chars, ALL) if len(chars) <= 8 else (None, ALL)
    if op is sre.SUBPATTERN:
        return _walk(arg[3], (flags | arg[1]) & ~arg[2], most)
    if op is sre.BRANCH:
        found = [_walk(x, flags, most) for x in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= most:
            return set().union(*(e for e, _ in found)), ALL
        return None, _or(q if e is None else _strings(e) for e, q in found)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, sub = arg
        exact, q = _walk(sub, flags, most)
        if low == 0:
            return (exact | {b""}, ALL) if high == 1 and exact is not None else (None, ALL)
        if low == high == 1:
            return exact, q
        return None, (q if exact is None else _strings(exact))
    return None, ALL


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; ``("all",)`` where no trigram is mandatory."""
    tree = parser.parse(pattern)
    exact, query = _walk(tree, tree.state.flags)
    return query if exact is None else _strings(exact)


def trigrams_in(query) -> set[bytes]:
    return set() if query == ALL else {query[1]} if query[0] == "tri" else set().union(*map(trigrams_in, query[1]))


class TrigramIndex:
    """Posting lists of one segment of texts for the trigrams that some queries ask for, made in one pass."""

    def __init__(self, texts: list[str], number: np.ndarray, names: list[bytes]):
        """number: of each of the 2**24 trigrams its place in names plus 1, or 0."""
        folded = [_fold(t) for t in texts]
        self.every = np.arange(len(texts))
        data = np.frombuffer(b"\xff\xff".join([*folded, b""]), np.uint8).astype(np.int32)  # no text holds the byte FF
        found = number[data[:-2] << 16 | data[1:-1] << 8 | data[2:]] if len(data) > 2 else np.zeros(0, number.dtype)
        at = np.flatnonzero(found)
        which = found[at].astype(np.int64) - 1
        ends = np.cumsum([len(f) + 2 for f in folded])
        doc = np.searchsorted(ends, at, side="right")
        pairs = np.unique(which * len(texts) + doc)
        cuts = np.searchsorted(pairs, np.arange(len(names) + 1) * len(texts))
        self.lists = {t: pairs[lo:hi] % len(texts) for t, lo, hi in zip(names, cuts[:-1], cuts[1:], strict=True)}

    def answer(self, query) -> np.ndarray:
        """The documents that satisfy a query, ascending."""
        if query == ALL:
            return self.every
        if query[0] == "tri":
            return self.lists[query[1]]
        answers = sorted(map(self.answer, query[1]), key=len)
        if query[0] == "or":
            return np.unique(np.concatenate(answers))
        out = answers[0]
        for a in answers[1:]:
            out = np.intersect1d(out, a, assume_unique=True)
        return out


class Scanner:
    """The rules compiled once a task."""

    def __init__(self, rules=RULES):
        self.rules = [(i, r, re.compile(r.pattern), trigram_query(r.pattern)) for i, r in enumerate(rules)]
        self.names = sorted(set().union(*(trigrams_in(q) for *_, q in self.rules)))
        self.number = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(self.names):
            self.number[int.from_bytes(t, "big")] = k + 1

    def candidates(self, texts: list[str]) -> list[tuple[int, Rule, re.Pattern, list[int]]]:
        """Of each rule the texts that its trigrams allow."""
        index = TrigramIndex(texts, self.number, self.names)
        return [(i, rule, regex, index.answer(query).tolist()) for i, rule, regex, query in self.rules]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule number, end), sorted."""
        out: list[list] = [[] for _ in texts]
        lo, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= SEGMENT or k + 1 == len(texts):
                for i, rule, regex, found in self.candidates(texts[lo : k + 1]):
                    for d in found:
                        for m in regex.finditer(texts[lo + d]):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                out[lo + d].append((m.start(), i, m.end()))
                lo, size = k + 1, 0
        for x in out:
            x.sort()
        return out


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, spans) for every row of df; spans are in code points, ends exclusive, ordered by start, then by rule."""

    def scan(batch: pa.RecordBatch, scanner: Scanner):
        found = scanner.spans([t or "" for t in batch.column("text").to_pylist()])
        spans = [[{"kind": rules[i].kind, "start": a, "end": b, "base": rules[i].base} for a, i, b in x] for x in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, scan, f"doc_id long, spans {SPANS}", lambda: Scanner(rules))


def mask(text: str, spans: list[tuple[int, int, int]], rules=RULES) -> str:
    """The text with every span (overlapping ones as one) replaced by the first one's kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{rules[kind].kind.upper()}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str = "n_chars", rules=RULES) -> DataFrame:
    """df with secrets masked in text_col and length_col (where present) brought up to date; all rows and columns stay."""
    names = df.columns

    def redact(batch: pa.RecordBatch, scanner: Scanner):
        texts = batch.column(text_col).to_pylist()
        found = scanner.spans([t or "" for t in texts])
        new = [mask(t, s, rules) if s else t for t, s in zip(texts, found, strict=True)]
        columns = [batch.column(c) for c in names]
        columns[names.index(text_col)] = pa.array(new, batch.schema.field(text_col).type)
        if length_col in names:
            at = names.index(length_col)
            old = columns[at].to_pylist()
            columns[at] = pa.array([len(n) if s else o for n, s, o in zip(new, found, old, strict=True)], batch.schema.field(length_col).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(df, redact, df.schema, lambda: Scanner(rules))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every document's secret counts and digests."""
    from .common import table

    found = scan_secrets(table(spark, sf_dir, "documents"))
    mark = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, mark), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
