"""Words of whole Arrow text batches as flat numpy arrays, and their rolling hashes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. All functions work on
a batch of documents at once: no Python loop runs over words or characters. A
null text has no words.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


@functools.cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below ``size`` (base odd)."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, 1 << max(16, int(n).bit_length()))
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
WORD_BASE, RUN_BASES = 0xD6E8FEB86659FD93, (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string (or binary) column and its n+1 offsets; nulls are empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if offs is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document) of all words; a document's end also ends a word."""
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([True], ~inside[:-1])) if n else np.zeros(0, bool)
    after = np.concatenate((~inside[1:], [True])) if n else np.zeros(0, bool)
    start = np.flatnonzero(inside & (before | edge[:n]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words wherever they stand."""
    up, _ = powers(WORD_BASE, len(data))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(BYTE_CODES[data] * up, dtype=_U)))
    _, down = powers(WORD_BASE, len(data) + 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def run_hashes(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries of ``h`` (len(h)-k+1 of them)."""
    if len(h) < k:
        return np.zeros(0, _U)
    up, down = powers(base, len(h) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(h * up[: len(h)], dtype=_U)))
    n = len(h) - k + 1
    return mix((sums[k:] - sums[:n]) * down[:n])


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """``op`` over each window of ``w`` entries (len(x)-w+1 of them), by doubling."""
    if len(x) < w:
        return x[:0]
    n, have = len(x) - w + 1, 1
    y = x
    while have * 2 <= w:
        y = op(y[:-have], y[have:])
        have *= 2
    return op(y[:n], y[w - have : w - have + n])
