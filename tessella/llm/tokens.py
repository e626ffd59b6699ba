"""Exact, cached encoding with the files of public tokenizers.

A text is cut where the tokenizer's own pre-tokenisation is certain to cut, the
parts are looked up, and only parts not seen before go through the library
(its normaliser, pre-tokeniser and model).  The ids equal those of
``Tokenizer.encode(text, add_special_tokens=False)``: a text that holds the string of
a special token goes through the library as a whole, which gives that token's id.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata

import numpy as np

_SPACE = r" \t\n\r\x0b\x0c"
#: A run of spaces belongs to what precedes, but for its last character.
_PARTS = re.compile(f"[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+")
#: White space to which the rule above is not applied.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

#: Letters and signs for which splitting by the patterns below is certain to equal the
#: tokenizers' own; parts with any other character beyond ASCII go through their pre-tokenisers.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_SIGNS = "\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u205e\u20ac"
_PLAIN = re.compile(f"[\\x00-\\x1b\\x20-\\x7e{_LATIN}{_SIGNS}]*")
_CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
_KEEPING = re.compile(f" ?[{_LATIN}]+|{_CONTRACTIONS}| ?[0-9]+| ?[^{_SPACE}{_LATIN}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
_DROPPING = re.compile(f"[{_LATIN}]+|{_CONTRACTIONS}|[0-9]|[^{_SPACE}{_LATIN}0-9]+")

#: Characters of the longest string whose ids are kept.
_LONG = 48

_LOADED: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level models use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_STAND_IN = _byte_letters()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Learned(dict):
    """Ids by key; a key not seen before is asked for.

    Two generations bound the memory: a full one becomes the old one, from which what is used again is
    taken over.  Long keys are not kept, so bytes are bounded with the number of keys.
    """

    def __init__(self, ask, limit: int):
        super().__init__()
        self.ask, self.limit, self.old = ask, limit, {}

    def __missing__(self, key):
        ids = self.old.get(key)
        if ids is None:
            ids = self.ask(key)
        if len(key) <= _LONG:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Encoder for one tokenizer file; ``encode`` returns little-endian uint32 ids.

    At most four times ``limit`` short strings and their ids are kept.
    """

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.norm, self.pre, self.model = self.tok.normalizer, self.tok.pre_tokenizer, self.tok.model
        # case as in a normalised text, so no text with a special token's string is overlooked
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        # signs that all of them begin with are looked for first
        self.sign = re.match(r"[^\w\s]*", os.path.commonprefix(added))[0] if added else "\0"
        self.pieces, self.parts = _Learned(self._piece, limit), _Learned(self._part, limit)
        # with this normaliser white space only separates; otherwise it is kept
        self.drops_space = self.norm is not None and self.tok.encode(" \n ", add_special_tokens=False).ids == []

    def _full(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ids(self, stand_in: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(stand_in)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of plain text."""
        return self._ids(piece.encode().decode("latin-1").translate(_STAND_IN))

    def _part(self, part: str) -> bytes:
        """Ids of a part of any text, cut by the tokenizer itself."""
        s = part if self.norm is None else self.norm.normalize_str(part)
        return b"".join([self._ids(x) for x, _ in self.pre.pre_tokenize_str(s)])

    def encode(self, text: str) -> bytes:
        if self.sign in text and self.special.search(text):
            return self._full(text)
        if _PLAIN.fullmatch(text):
            found = _DROPPING.findall(text.lower()) if self.drops_space else _KEEPING.findall(text)
            return b"".join(map(self.pieces.__getitem__, found))
        if self.drops_space:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            return b"".join([self.parts[p.decode()] for p in text.encode().lower().split()])
        if _ODD_SPACE.search(text):
            return self._full(text)
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text)))


def encoder(path: str) -> Encoder:
    """The task's encoder for a file; a worker process keeps it for later tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
