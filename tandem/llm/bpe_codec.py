"""Byte-level BPE with a sentencepiece model that is written straight from a vocabulary.

The model file is made from the ranks: each token's bytes are mapped to
letters, its score is the negative rank, and normalisation is the identity.
Merging the best-scored pair first is then the same as merging the lowest
rank first. Texts are cut into pre-tokens by a pattern; a pre-token that is a
token of the vocabulary is that token, others are merged by sentencepiece.
Decoding maps ids back to letters and letters back to bytes.

Defined results: null and empty texts have no ids and decode to no bytes; null
ids decode to no bytes; further columns stay, those with the names of new
ones are replaced.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tandem.llm.common import append_columns
from tandem.llm.encoders import ByteEncoder, byte_letters, pack_ids, read_ranks

# fixed value: the pre-token pattern of the public byte-level vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: an int, a float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(int(value))


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model: piece i is token i in letters with score -i; an unknown piece comes last."""
    letters = byte_letters()
    names = ["".join([letters[b] for b in t]) for t in tokens]
    unknown = "<unk>"
    while unknown in set(names):
        unknown += ">"
    pieces = [_field(1, _field(1, n.encode()) + _field(2, float(-i)) + _field(3, 1)) for i, n in enumerate(names)]
    pieces.append(_field(1, _field(1, unknown.encode()) + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(
        43, -1) + _field(45, unknown.encode())
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class BpeCodec:
    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.ranks = {t: pack_ids([i]) for i, t in enumerate(tokens)}
        self.letters = byte_letters()
        back = {c: b for b, c in self.letters.items()}
        self.bytes = [bytes([back[c] for c in self.model.id_to_piece(i)]) for i in range(len(tokens))]
        self.pattern = regex.compile(pattern)
        self._encoder = ByteEncoder(self.whole, self.piece) if pattern == PATTERN else self.whole

    def piece(self, pre_token: bytes) -> bytes:
        got = self.ranks.get(pre_token)
        if got is None:
            letters = self.letters
            got = pack_ids(self.model.encode("".join([letters[b] for b in pre_token])))
        return got

    def whole(self, text: bytes) -> bytes:
        return b"".join([self.piece(p.encode()) for p in self.pattern.findall(text.decode("utf-8", "replace"))])

    def encode(self, text: bytes) -> bytes:
        return self._encoder(text) if text else b""

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(ranks: str) -> BpeCodec:
    return BpeCodec(read_ranks(ranks))


def encode(docs: DataFrame, ranks: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int) of whole texts by the vocabulary in the file ``ranks``."""
    at = docs.drop(ids).columns.index(text)

    def make():
        c = codec(ranks)

        def run(b: pa.RecordBatch) -> list[pa.Array]:
            got = [c.encode(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *(len(g) // 4 for g in got)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))]

        return run

    return append_columns(docs, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for."""
    at = df.drop(out).columns.index(ids)

    def make():
        c = codec(ranks)

        def run(b: pa.RecordBatch) -> list[pa.Array]:
            col = b.column(at)
            flat = col.flatten().to_pylist() if not col.null_count else [x for v in col.to_pylist() for x in v or ()]
            ends = np.cumsum([n or 0 for n in col.value_lengths().to_pylist()]).tolist()
            starts = [0, *ends[:-1]]
            return [pa.array([c.decode(flat[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary())]

        return run

    return append_columns(df, [T.StructField(out, T.BinaryType())], make)
