"""Encoding whole texts with a tokenizers file, words cached.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. Byte-level BPE
first cuts a text by a pattern and then merges within each cut, so a cut's ids do
not depend on its neighbours; most words recur, and a bounded cache of their ids
saves most of the merging. A text with characters outside plain Latin ranges, or
with the text of a special token, goes to the tokenizer whole, and so does every text if
the file is of another kind than byte-level BPE with this cut and no normaliser.
"""

from __future__ import annotations

import gc
import json
import re
import sys
from array import array

import regex

from .common import prefer_local_threads

#: Fixed value: the byte-level pattern by which this vocabulary's texts are cut.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNUSUAL = re.compile(r"[^\t\n\r -~\u00a0-\u024f]")
#: Bytes of texts that need no closer look: printable ASCII, tab, line ends, and the letters up to U+023F.
PLAIN = bytes([9, 10, 13, *range(32, 127), *range(128, 192), *range(0xC3, 0xC9)])
BEFORE_SPACE = ("  ", "\n ", "\t ", "\r ", "\u00a0 ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as letters from 256 on, in order."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def _bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class _Cache(dict):
    """A bounded dict of two generations that makes what it lacks; what is not asked for while the young one fills is forgotten."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def byte_level(file: dict) -> bool:
    """Whether a tokenizers file cuts and merges as CUT and _merge do."""
    pre, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return bool(plain and bpe and not file.get("normalizer") and not file.get("truncation") and not file.get("padding"))


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None, most: int = 500_000):
        prefer_local_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.model = self.tokenizer.model
        self.by_cuts = byte_level(json.loads(self.tokenizer.to_str()))
        self.pieces = _Cache(most, self._piece)  # what stands between two single spaces, with the space before it
        self.cuts = _Cache(most // 4, self._cut)  # other cuts
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merge(self, letters: str) -> bytes:
        """The ids of one cut: the model's merges alone, without the rest of the tokenizer's work on a text."""
        return _bytes([t.id for t in self.model.tokenize(letters)])

    def _cut(self, cut: str) -> bytes:
        return self._merge(cut.encode().decode("latin-1").translate(BYTE_LETTERS))

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece after a space; one of letters is a single cut."""
        if piece.isalpha():
            return self._merge("Ġ" + (piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)))
        word = piece.rstrip(".,;:!?")
        if word.isalpha():
            return self.pieces[word] + self.cuts[piece[len(word) :]]
        return b"".join([self.pieces[c[1:]] if c[0] == " " and c[1:].isalpha() else self.cuts[c] for c in CUT.findall(" " + piece)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none)."""
        if not self.by_cuts:
            return self._whole([t or "" for t in texts])
        piece, cut, out, later = self.pieces.__getitem__, self.cuts.__getitem__, [], []
        collecting = gc.isenabled()
        gc.disable()  # many short lists and no cycles
        try:
            for k, t in enumerate(texts):
                if not t:
                    out.append(b"")
                    continue
                self.pieces.turn()
                self.cuts.turn()
                if (t.encode().translate(None, PLAIN) and UNUSUAL.search(t)) or any(a in t for a in self.added):
                    out.append(b"")
                    later.append(k)
                elif any(s in t for s in BEFORE_SPACE):
                    out.append(b"".join(map(cut, CUT.findall(t))))
                else:
                    first, *rest = t.split(" ")
                    out.append(b"".join([*map(cut, CUT.findall(first)), *map(piece, rest)]))
        finally:
            if collecting:
                gc.enable()
        for k, ids in zip(later, self._whole([texts[k] for k in later]), strict=True):
            out[k] = ids
        return out


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The process's encoder for a file, so that a Python worker keeps its cache from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
