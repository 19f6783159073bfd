"""Whole-text encoding with a ``tokenizers`` vocabulary, one cached call per distinct word.

A byte-level BPE never joins characters across a single space between two non-space characters:
the space starts the next piece. So a text may be cut there, each cut piece encoded on its own
(with its space) and the ids concatenated. The pieces repeat, so a bounded cache answers most of
them. A piece of letters only is one word to the tokenizer's splitter, so it goes to its merge model
directly; any other goes through the whole tokenizer. ``tests/llm/test_llm.py`` holds the result
against ``Tokenizer.encode`` of whole texts.
"""

from __future__ import annotations

import re
import sys
from array import array

#: Entries of a generation of the cache; a worker keeps two generations of each of two caches.
CACHE_ENTRIES = 350_000
_LONGEST_CACHED = 48
#: Letters below this are letters to any version of Unicode's tables.
_PLAIN = "\u0250"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TRAILING = frozenset(".,;:!?")


class _Odd(Exception):
    """A piece that isn't bounded by non-space characters."""


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printed,
    else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: b for b in shown}
    for b in range(256):
        table.setdefault(b, 0x100 + len(table) - len(shown))
    return table


class _Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit bytes. Of two generations the younger is
    this dictionary; when it is full it becomes the older one, so what is asked for often stays."""

    def __init__(self, encode, prefix: str, plain: "_Pieces | None" = None):
        super().__init__()
        self._encode, self._prefix, self._plain = encode, prefix, self if plain is None else plain
        self._older: dict[str, bytes] = {}

    def _found(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Odd
        at = piece.find("\n")
        if at > 0 and not piece[at - 1].isspace() and not piece[at + 1].isspace():
            return self[piece[:at]] + self._plain.newline + self._plain[piece[at + 1 :]]
        if piece[-1] in _TRAILING and len(piece) > 1 and piece[:-1].isalpha() and max(piece) < _PLAIN:
            return self[piece[:-1]] + self._plain[piece[-1]]
        return self._encode(self._prefix + piece)

    def __missing__(self, piece: str) -> bytes:
        ids = self._older.get(piece)
        if ids is None:
            ids = self._found(piece)
        if len(piece) <= _LONGEST_CACHED:
            if len(self) >= CACHE_ENTRIES:
                self._older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """``ids(text)``: the ids of the whole text as bytes (unsigned 32-bit, little-endian)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._bytes = self._tokenizer.model, _byte_characters()
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._first = _Pieces(self._piece, "")
        self._first.newline = self._raw("\n")
        self._rest = _Pieces(self._piece, " ", self._first)

    def _raw(self, text: str) -> bytes:
        return _little_endian(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, text: str) -> bytes:
        word = text[1:] if text[0] == " " else text
        if word.isalpha() and max(word) < _PLAIN:
            spelt = text.encode().decode("latin-1").translate(self._bytes)
            return _little_endian([t.id for t in self._model.tokenize(spelt)])
        return self._raw(text)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self._special):
            return self._raw(text)
        rest = self._rest
        try:
            head, *words = text.split(" ")
            return b"".join([self._first[head], *[rest[w] for w in words]])
        except _Odd:
            head, *pieces = _CUT.split(text)
            out = [self._raw(head)]
            for p in pieces:
                try:
                    out.append(rest[p])
                except _Odd:
                    out.append(self._raw(" " + p))
            return b"".join(out)


def _little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
