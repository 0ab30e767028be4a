"""Token ids of whole texts under the two byte-pair vocabularies, with a bounded memory of words seen before.

A tokenizer first cuts a text into pre-tokens and then merges inside each, so equal pre-tokens have equal ids wherever they stand.
Texts made of ASCII and Latin-1 characters (``PLAIN``) are cut here by the tokenizer's own pattern, spelled out for those
characters; pre-tokens not yet known go through the tokenizer's merges. All other texts, and texts that may hold a special
token, are encoded whole by the tokenizer. The tests compare both routes with encoding whole texts.
"""

from __future__ import annotations

import os
import re
import struct

CACHE = 400_000           # pre-tokens a worker remembers; only speed depends on it
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = r" \t\n\x0b\x0c\r\x85\xa0"
PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~\x85\xa0-\xff]*")
#: The pre-token patterns of the vocabularies (fixed values), with letters, numbers and spaces spelled out for plain texts.
BYTE_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WORD_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable Latin-1 characters stand for themselves, the others for U+0100 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Pre-token to the bytes of its ids; an unknown one goes through the tokenizer's merges."""

    def __init__(self, model):
        self.merge = model.tokenize
        self.letters = {chr(b): c for b, c in _byte_letters().items()}.__getitem__

    def __missing__(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece.isalnum() else "".join(map(self.letters, piece.encode().decode("latin-1")))
        ids = [t.id for t in self.merge(spelled)]
        out = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """Ids of texts under one tokenizer file. ``words``: the vocabulary that drops spaces and case. One per Python worker."""

    def __init__(self, path: str, words: bool, end_id: int, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.cut = (lambda t: WORD_CUT.findall(t.lower())) if words else BYTE_CUT.findall
        self.end, self.most = struct.pack("<I", end_id), cache
        self.known = _Known(self.whole.model)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text and the end id, as little-endian unsigned 32-bit numbers."""
        if len(self.known) > self.most:
            self.known.clear()
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.known.__getitem__, self.cut(text))) + self.end
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids) + self.end


_ENCODERS: dict[tuple, Encoder] = {}


def forget() -> None:
    """Drop all encoders of this worker."""
    _ENCODERS.clear()


def encoder(path: str, words: bool, end_id: int) -> Encoder:
    """The worker's encoder; Spark reuses Python workers, so the file is read once per worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, words, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
