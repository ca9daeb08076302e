"""Packing of documents into token sequences by minimum bin slack.

Each task reads its documents once. Windows of ``capacity`` ids that a document
fills by itself leave at once; remainders are kept by length. A plan then fills
windows: the longest remainder is fixed, and a subset-sum program over bitsets
(one big integer, bit *s* set where *s* ids can be reached) picks the multiset
of remaining lengths that comes closest to the free room. Backtracking gives
how many of each length it takes, and the same filling is repeated as often as
the counts allow. Remainders for which no multiset closes the window are laid
end to end and cut at the capacity; the last ids of a task are cut into powers
of two. So no sequence is padded, and only these few remainders are cut.

One narrow pass: no shuffle, nothing global, memory bounded by
``BUFFER_TOKENS``. A lost task is run again from its input split.

Defined results: a null text counts as empty and gives the end id alone; rows
with the same id are documents of their own; a null id is kept; an empty table
gives no pieces; further columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import prepare
from tandem.llm.encoders import hf_encoder, pack_ids

CAPACITY = 2048
BUFFER_TOKENS = 4_000_000
_OUT_ROWS = 1000


def best_filling(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each of ``lengths`` fill ``room`` best without exceeding it (bounded by ``counts``)."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # (reachable before, length, how many)
    for n in lengths:
        left, part = min(counts[n], room // n), 1
        while left > 0:
            take = min(part, left)
            steps.append((reach, n, take))
            reach |= (reach << (take * n)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for before, n, take in reversed(steps):
        if not before >> at & 1:
            used[n] += take
            at -= take * n
    return dict(used)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Fillings that close a window exactly, with their repeats, and the counts that are left over."""
    counts, rest, out = dict(counts), {}, []
    for top in sorted(counts, reverse=True):
        while counts[top]:
            room = capacity - top
            counts[top] -= 1
            smaller = sorted((n for n, c in counts.items() if c and n <= min(room, top)), reverse=True)
            used = best_filling(smaller, counts, room) if room else {}
            counts[top] += 1
            if sum(n * k for n, k in used.items()) < room:
                rest[top], counts[top] = counts[top], 0
                break
            used[top] = used.get(top, 0) + 1
            times = min(counts[n] // k for n, k in used.items())
            out.append((used, times))
            for n, k in used.items():
                counts[n] -= k * times
    return out, rest


class _Packer:
    """Pieces of one task. A piece: (key, start, ids as bytes, ids of its document)."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.kept: dict[int, list] = defaultdict(list)
        self.tokens = 0
        self.out: list[tuple] = []

    def add(self, key, ids: bytes) -> None:
        total, size = len(ids) // 4, 4 * self.capacity
        full = len(ids) // size
        for i in range(full):
            self._emit([(key, i * self.capacity, ids[i * size : (i + 1) * size], total)])
        if len(ids) > full * size:
            rest = ids[full * size :]
            self.kept[len(rest) // 4].append((key, full * self.capacity, rest, total))
            self.tokens += len(rest) // 4
            if self.tokens >= BUFFER_TOKENS:
                self.fill(False)

    def _emit(self, pieces: list) -> None:
        at = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((key, start, n, total, self.next, at, ids))
            at += n
        self.next += 1

    def take(self, n: int) -> list[tuple]:
        """Up to ``n`` finished pieces; they are no longer held."""
        rows, self.out = self.out[:n], self.out[n:]
        return rows

    def fill(self, last: bool) -> None:
        fillings, rest = plan({n: len(x) for n, x in self.kept.items() if x}, self.capacity)
        for used, times in fillings:
            for _ in range(times):
                self._emit([self.kept[n].pop() for n, k in used.items() for _ in range(k)])
        window: list = []
        room = self.capacity
        for n in rest:
            for key, start, ids, total in self.kept[n]:
                while ids:
                    cut = min(room, len(ids) // 4)
                    window.append((key, start, ids[: 4 * cut], total))
                    ids, start, room = ids[4 * cut :], start + cut, room - cut
                    if not room:
                        self._emit(window)
                        window, room = [], self.capacity
        self.kept, self.tokens = defaultdict(list), 0
        if last:
            self._powers_of_two(window)
        else:
            for piece in window:
                self.kept[len(piece[2]) // 4].append(piece)
                self.tokens += len(piece[2]) // 4

    def _powers_of_two(self, window: list) -> None:
        left = sum(len(p[2]) // 4 for p in window)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            now = []
            while room:
                key, start, ids, total = window.pop(0)
                cut = min(room, len(ids) // 4)
                now.append((key, start, ids[: 4 * cut], total))
                room -= cut
                if len(ids) > 4 * cut:
                    window.insert(0, (key, start + cut, ids[4 * cut :], total))
            self._emit(now)


def pack(docs: DataFrame, encoder: Callable[[], Callable[[bytes], bytes]], end_id: int, capacity: int = CAPACITY,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, ``start`` in its document, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and
    ``ids`` (little-endian unsigned 32-bit). ``encoder()`` is called in each task and gives text bytes -> id bytes."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(key), F.col(text).cast("binary"))
    kind = src.schema[0]
    out = T.StructType([kind, *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")),
                        T.StructField("ids", T.BinaryType())])
    end = pack_ids([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        packer = _Packer(capacity, TaskContext.get().partitionId() << 33)
        types = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*packer.take(_OUT_ROWS), strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], types), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.binary())],
                names=out.names)

        for b in batches:
            types = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(k, encode(t or b"") + end)
                while len(packer.out) >= _OUT_ROWS:  # a plan finishes all its pieces at once
                    yield flush()
        packer.fill(True)
        while packer.out:
            yield flush()

    return src.mapInArrow(run, out)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """:func:`pack` with a ``tokenizers`` file."""
    return pack(docs, lambda: hf_encoder(tokenizer), end_id, capacity)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the pieces of each sequence put together (at most the capacity of ids in a group)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
