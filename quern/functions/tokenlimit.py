"""Token counts and limits with an injected tokenizer; white-space words stand in where none is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..config import DEFAULTS

#: Values of an Arrow batch that are Python objects at once.
SLICE = 256


def by_slices(of: Callable[[str], object], kind: pa.DataType):
    """A UDF of texts (null: empty), which are Python objects a slice at a time, not a whole Arrow batch."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            done = [pa.array([of(t or "") for t in a.slice(lo, SLICE).to_pylist()], kind) for lo in range(0, len(a), SLICE)]
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    return F.arrow_udf(run, {pa.string(): "string", pa.int32(): "int"}[kind])


def count_tokens(encode: Callable[[str], list] | None = None):
    enc = encode or str.split
    return by_slices(lambda t: len(enc(t)), pa.int32())


def truncate_to_limit(limit: int = DEFAULTS.embed_input_tokens, step: int = DEFAULTS.truncate_step, encode: Callable[[str], list] | None = None, decode: Callable[[list], str] | None = None):
    """Texts as they are sent (line ends as spaces) held to limit tokens: a longer one loses step tokens at a time until it fits."""
    enc, dec = encode or str.split, decode or " ".join

    def fit(text: str) -> str:
        sent = text.replace("\n", " ")
        tokens = enc(sent)
        if len(tokens) <= limit:
            return text
        keep = limit
        while keep > 0:
            cut = dec(tokens[:keep])
            if len(enc(cut.replace("\n", " "))) <= limit:
                return cut
            keep -= step
        return ""

    return by_slices(fit, pa.string())
