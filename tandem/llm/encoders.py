"""Encoders that run public tokenizers over whole texts, one blank-separated chunk at a time.

Texts repeat their words, so a worker keeps the ids of the chunks it has met
(two generations, ``KEEP_WORDS`` or ``KEEP_CHUNKS`` each) and asks the tokenizer for new ones
only. The chunks are cut where no token of the tokenizer can cross, so the
ids equal those of the whole text; texts where that isn't certain (runs of
blanks) go to the tokenizer as a whole. Ids are little-endian unsigned 32-bit
integers in ``bytes``.
"""

from __future__ import annotations

import base64
import functools
import gc
import json
import os
import struct
from collections.abc import Callable

KEEP_WORDS, KEEP_CHUNKS = 50_000, 800_000
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # one piece as a run behind letters; no apostrophe


def pack_ids(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Chunks(dict):
    """Ids of chunks; ``make`` gives those of a new one, None where a chunk can't stand alone."""

    def __init__(self, make: Callable, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, chunk: bytes):
        got = self.old.get(chunk, self)
        if got is self:
            got = self.make(chunk)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[chunk] = got
        return got


def _plain(w: bytes) -> bool:
    """Latin letters only (below U+0250, composed, İ apart): one piece in any letter pattern, unchanged by NFC."""
    if w.isascii():
        return w.isalpha()
    s = w.decode()
    return s.isalpha() and max(s) < "\u0250" and "\u0130" not in s


class WordEncoder:
    """For tokenizers that drop white space: each word of a text is encoded for itself.

    ``whole`` encodes any text, ``letters`` a word of lower-case Latin letters.
    """

    def __init__(self, whole: Callable[[bytes], bytes], letters: Callable[[bytes], bytes]):
        self.whole, self.letters = whole, letters
        self.chunks = _Chunks(self._new, KEEP_WORDS)

    def _new(self, w: bytes) -> bytes:
        if _plain(w):
            low = w.decode().lower().encode()
            return self.letters(w) if low == w else self.chunks[low]
        body = w.rstrip(_MARKS)
        if body != w and _plain(body):
            return self.chunks[body] + self.chunks[w[len(body) :]]
        return self.whole(w)

    def __call__(self, text: bytes) -> bytes:
        # A-Z may go to lower case first where no combining mark could join them
        if b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return b"".join(map(self.chunks.__getitem__, text.split()))


class ByteEncoder:
    """For byte-level tokenizers whose pattern lets one blank lead a word (`` ?\\p{L}+`` ...).

    A chunk is a blank, or a line feed, with all up to the next one. Cutting
    before it is exact unless the chunk before ends in white space too. ``whole``
    encodes any text, ``piece`` one piece of the pattern.
    """

    def __init__(self, whole: Callable[[bytes], bytes], piece: Callable[[bytes], bytes]):
        self.whole, self.piece = whole, piece
        self.chunks = _Chunks(self._new, KEEP_CHUNKS)
        self.marks = _Chunks(piece, 10_000)

    def _new(self, w: bytes) -> bytes | None:
        if not w or w[-1:].isspace() or not w[-1:].isascii() and w.decode()[-1].isspace():
            return None
        if w.isalpha() or _plain(w):
            return self.piece(b" " + w)
        body = w.rstrip(_MARKS)
        if body != w and _plain(body[1:] if w[0] == 10 else body):
            return self.chunks[body] + self.marks[w[len(body) :]]
        if w[0] == 10:
            return self.marks[b"\n"] + self.piece(w[1:]) if _plain(w[1:]) else self.whole(w)
        return self.whole(b" " + w)

    def __call__(self, text: bytes) -> bytes:
        first, *rest = text.replace(b"\n", b" \n").split(b" ")
        if not rest or not first or first.decode("utf-8", "replace")[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.chunks.__getitem__, rest))
        except TypeError:  # a chunk that can't stand alone
            return self.whole(text)


@functools.cache
def byte_letters() -> dict[int, str]:
    """The usual one-letter name of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def hf_encoder(path: str, spelled: bool = False) -> Callable[[bytes], bytes]:
    """Encoder of a ``tokenizers`` file that adds no special tokens; kept per worker.

    The string of a special token in a text gives its id, as the library has it by default; ``spelled``: it is ordinary text.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    gc.set_threshold(100_000, 50, 100)  # the chunks kept are bytes that no cycle can hold; walking them is in vain
    full = Tokenizer.from_file(path)
    full.encode_special_tokens = spelled
    spec = json.loads(full.to_str())
    special = [] if spelled else [t["content"].encode() for t in spec.get("added_tokens") or []]
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, full.model

    def whole(text: bytes) -> bytes:
        return pack_ids(full.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    names = byte_letters()

    def merged(piece: bytes) -> bytes:
        if piece.isalpha():
            text = piece.decode()
        elif piece[0] == 32 and piece[1:].isalpha():
            text = names[32] + piece[1:].decode()
        else:
            text = "".join([names[x] for x in piece])
        return pack_ids([t.id for t in model.tokenize(text)])

    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return _beside(special, whole, ByteEncoder(whole, merged))
    kinds = [x["type"] for x in norm.get("normalizers", [])]
    if kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
        return _beside(special, whole, WordEncoder(whole, merged))
    return whole


def _beside(special: list[bytes], whole: Callable[[bytes], bytes], encode: Callable[[bytes], bytes]) -> Callable[[bytes], bytes]:
    """``encode``, but texts that hold a special token's string go to the library ``whole``."""
    return (lambda text: whole(text) if any(s in text for s in special) else encode(text)) if special else encode


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a ``.tiktoken`` file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out
