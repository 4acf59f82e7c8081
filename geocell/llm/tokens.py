"""Byte-pair ids, fast where words repeat: pieces of text that the tokenizer never joins are encoded once a worker."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

#: A space followed by anything but white space always starts a new pre-token, so text may be cut there.
_CUT = re.compile(r" (?=[^\s᠎])")
_UNSAFE = re.compile(r" (?=[\s᠎]|\Z)")
CACHE = 400_000
#: The vocabulary's added token: the tokenizer's .json form cuts texts at it before anything else, and gives it this id.
SPECIAL = ("<|endoftext|>", 50256)


class _Ids(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; bounded, refilled when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = array("I", self.encode(piece)).tobytes()
        if len(piece) <= 32:
            self[piece] = ids
        return ids


@lru_cache(4)
def cache(path: str, pattern: str) -> _Ids:
    """path: a .tiktoken ranks file. Its ids equal those of the .json file of the same name, but for the added token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _Ids(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)


def encode_document(text: str, ids: _Ids, special: tuple[str, int] = SPECIAL) -> bytes:
    """All ids of the text, 4 bytes each, as the tokenizer gives them by default: the added token has its own id."""
    name, number = special
    if name not in text:
        return encode(text, ids)
    return number.to_bytes(4, "little").join([encode(part, ids) for part in text.split(name)])


def encode(text: str, ids: _Ids) -> bytes:
    """All ids of the text, 4 bytes each; the added token is plain text."""
    pieces = _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
    if len(pieces) == 1:
        return ids[text]
    return ids[pieces[0]] + b"".join([ids[" " + p] for p in pieces[1:]])
