"""Chunks at the boundaries of a text: paragraphs, else sentences, else words, within a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import DEFAULTS

#: Where a text may end, the strongest first: after an empty line, a sentence, a line, white space.
BOUNDARIES = (re.compile(r"\n\s*\n"), re.compile(r"[.!?。！？][\"')\]]*\s+"), re.compile(r"\n"), re.compile(r"\s+"))


def words(text: str) -> int:
    return len(text.split())


def units(text: str, start: int, count: Callable[[str], int], size: int, level: int = 0) -> list[tuple[int, int]]:
    """(start, end) of stretches of at most size tokens that join to the text, split only as far down as they must be."""
    if count(text) <= size:
        return [(start, start + len(text))] if text else []
    if level == len(BOUNDARIES):  # one word beyond the budget: halves, until they fit
        if len(text) == 1:
            return [(start, start + 1)]
        half = len(text) // 2
        return units(text[:half], start, count, size, level) + units(text[half:], start + half, count, size, level)
    ends = [m.end() for m in BOUNDARIES[level].finditer(text)]
    cuts = [0, *(e for e in ends if e < len(text)), len(text)]
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        out += units(text[a:b], start + a, count, size, level + 1)
    return out


def chunks(text: str, size: int, overlap: int, count: Callable[[str], int] = words) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most size tokens (a single character may have more), each as many whole units as fit.

    The next chunk begins with the last units of the one before that have at most overlap tokens together, and goes
    on at least one unit further.
    """
    if not 0 <= overlap < size:
        raise ValueError("an overlap from 0 to below the size")
    parts = units(text, 0, count, size)
    tokens = [count(text[a:b]) for a, b in parts]
    out, first = [], 0
    while first < len(parts):
        last, total = first, tokens[first]
        while last + 1 < len(parts) and total + tokens[last + 1] <= size:
            last += 1
            total += tokens[last]
        while last > first and count(text[parts[first][0] : parts[last][1]]) > size:  # joined, tokens may be more
            last -= 1
        out.append((parts[first][0], parts[last][1]))
        if last + 1 == len(parts):
            break
        back, kept = last + 1, 0
        while back - 1 > first and kept + tokens[back - 1] <= overlap:
            back -= 1
            kept += tokens[back]
        # The overlap gives way where the next unit would not fit behind it.
        while back <= last and kept + tokens[last + 1] > size:
            kept -= tokens[back]
            back += 1
        while back <= last and count(text[parts[back][0] : parts[last + 1][1]]) > size:
            back += 1
        first = back
    return out


def chunk_text(df: DataFrame, text: str = "text", size: int = DEFAULTS.chunk_tokens, overlap: int = DEFAULTS.chunk_overlap, count: Callable[[str], int] | None = None) -> DataFrame:
    """df without the text, with chunk_idx, start, end (characters) and chunk; null and empty texts have none.

    Tokens are white-space words unless count says otherwise. A text is cut in one task, which holds its chunks one at
    a time as rows of at most some hundred.
    """
    kept = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)
    schema = ", ".join(x for x in (schema, "chunk_idx int, start long, `end` long, chunk string") if x)

    def run(batches):
        for b in batches:
            for row, t in enumerate(b.column(text).to_pylist()):
                found = chunks(t or "", size, overlap, count or words)
                for lo in range(0, len(found), 256):
                    some = found[lo : lo + 256]
                    at = pa.array([row] * len(some), pa.int64())
                    new = [pa.array(range(lo, lo + len(some)), pa.int32()), pa.array([a for a, _ in some], pa.int64()), pa.array([e for _, e in some], pa.int64()), pa.array([t[a:e] for a, e in some], pa.string())]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in kept), *new], [*kept, "chunk_idx", "start", "end", "chunk"])

    return df.mapInArrow(run, schema)
