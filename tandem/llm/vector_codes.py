"""Vector code compression: integer product codes learned over Hilbert-sorted flat blocks.

Components become integers, ``floor(scale * x)``, and vectors are cut into equal
consecutive parts. Each part position has a codebook, learned by rounds of exact
integer k-means:

1. *Blocks.* The parts of a position are sorted along a Hilbert curve (its
   ``KEY_DIMS`` components of largest variance) by a range exchange and cut into
   flat blocks of ``BLOCK`` parts. A block stores its parts as one run of
   integers, the smallest and largest value of each component (its box) and the
   sum of its parts. Blocks are written once; all rounds read them.
2. *Shortlist.* In a round each block compares its box with the codebook: an
   entry whose least possible distance to the box exceeds the smallest of the
   greatest possible distances of all entries can win for no part of the block.
   A block with one entry left gives its stored sum at once.
3. *Kernel.* Otherwise the parts are compared with the shortlist in exact integers
   (in doubles where every number that occurs stays below 2**53, else in 64-bit
   integers), ties to the lower index.
4. Sums and counts of a task leave it as one row an entry and are added up by
   Spark. The codebooks (``entries`` x dimension integers) are all that reaches
   the driver.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do those of another dimension than the vector of
the smallest id; a dimension that ``parts`` doesn't divide, or components so large that a
squared distance leaves 64 bits, are a ``ValueError``. Rows that repeat an id are
rows of their own (equal ids stand in the order of their vectors); a row without
an id is coded like any other but comes after all ids when codebooks start. With
fewer rows than ``entries`` the codebooks are smaller. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import broadcast_if, prepare
from tandem.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK, KEY_DIMS, KEY_BITS, LABELS = 128, 12, 60, 1_000_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (integers below ``2**bits``) along the Hilbert curve (Skilling 2004); ``bits`` x columns at most 63."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):  # undo the turns of each level
        low = (1 << level) - 1
        for i, a in enumerate(axes):
            high = (a >> level) & 1 == 1
            swap = np.where(high, 0, (axes[0] ^ a) & low)
            axes[0] = axes[0] ^ np.where(high, low, swap)
            if i:
                axes[i] = a ^ swap
    for i in range(1, len(axes)):  # Gray code over the axes
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> level) & 1 == 1, turn ^ ((1 << level) - 1), turn)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << 1) | (((a ^ turn) >> level) & 1)
    return key


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries of ``book`` that can be nearest to some point of the box, ascending."""
    below, above = low - book, book - high
    least = np.maximum(np.maximum(below, above), 0)
    most = np.maximum(book - low, high - book)
    least, most = (least * least).sum(1), (most * most).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(x: np.ndarray, book: np.ndarray, exact_doubles: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row, exactly; ties to the lower index."""
    a, b = (x.astype(np.float64), book.astype(np.float64)) if exact_doubles else (x, book)
    d = (b * b).sum(1) - 2 * (a @ b.T)
    best = d.argmin(1)
    return best, (d[np.arange(len(x)), best] + (a * a).sum(1)).astype(np.int64)


def _integers(col: pa.Array, dim: int, scale: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dim)


def _part_rows(rows: DataFrame, stats: dict, dim: int, parts: int, scale: int) -> DataFrame:
    """(part, place, rid, x): each part of each vector with its place along the curve."""
    width = dim // parts
    dims = min(KEY_DIMS, width)
    bits = min(16, KEY_BITS // dims)
    axes = [np.sort(np.argsort(-stats["var"][p * width : (p + 1) * width], kind="stable")[:dims]) for p in range(parts)]
    low, span = stats["low"], np.maximum(stats["high"] - stats["low"], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q, rid = _integers(b.column(1), dim, scale), b.column(0)
            cells = ((q - low) * ((1 << bits) - 1)) // span
            for p in range(parts):
                x = np.ascontiguousarray(q[:, p * width : (p + 1) * width])
                place = hilbert_keys(cells[:, p * width + axes[p]], bits)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p, np.int32)), pa.array(place), rid, pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))],
                    names=["part", "place", "rid", "x"])

    return rows.select("rid", "v").mapInArrow(run, "part int, place long, rid long, x array<long>")


def blocks(rows: DataFrame, stats: dict, dim: int, parts: int = PARTS, scale: int = SCALE, size: int = BLOCK) -> DataFrame:
    """(part, n, rids, x, low, high, total): flat blocks of Hilbert neighbours, integers as little-endian 64-bit runs."""
    width = dim // parts
    placed = _part_rows(rows, stats, dim, parts, scale).repartitionByRange("part", "place", "rid").sortWithinPartitions(
        "part", "place", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(p: int, rid: np.ndarray, x: np.ndarray) -> list:
            return [p, len(x), rid.tobytes(), x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes(), x.sum(0).tobytes()]

        def give(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.int32(), *[pa.binary()] * 5))],
                names=["part", "n", "rids", "x", "low", "high", "total"])

        held_part, held_rid, held = -1, np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        for b in batches:
            part = b.column(0).to_numpy()
            rid, x = b.column(2).to_numpy(), b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            out = []
            for p in np.unique(part).tolist():
                r, y = rid[part == p], x[part == p]
                if p == held_part:
                    r, y = np.concatenate((held_rid, r)), np.concatenate((held, y))
                elif len(held):
                    out.append(block(held_part, held_rid, held))
                whole = len(y) // size * size
                out += [block(p, r[i : i + size], y[i : i + size]) for i in range(0, whole, size)]
                held_part, held_rid, held = p, r[whole:], y[whole:]
            if out:
                yield give(out)
        if len(held):
            yield give([block(held_part, held_rid, held)])

    return cut_lineage(placed.mapInArrow(run, "part int, n int, rids binary, x binary, low binary, high binary, total binary"), "blocks")


def _ints(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(-1, width)


def _round(flat: DataFrame, books: list[np.ndarray], exact: bool) -> list[np.ndarray]:
    """The codebooks after one round; an entry without parts stays."""
    width, parts = books[0].shape[1], len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), width + 1), np.int64) for c in books]  # the last column counts
        for b in batches:
            for p, n, x, low, high, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                near = shortlist(_ints(low, width)[0], _ints(high, width)[0], books[p])
                if len(near) == 1:
                    sums[p][near[0], :-1] += _ints(total, width)[0]
                    sums[p][near[0], -1] += n
                    continue
                v = _ints(x, width)
                best, _ = nearest(v, books[p][near], exact)
                np.add.at(sums[p], (near[best], slice(0, width)), v)
                sums[p][:, -1] += np.bincount(near[best], minlength=len(books[p]))
        for p in range(parts):
            used = np.flatnonzero(sums[p][:, -1])
            if len(used):
                offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * (width + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)),
                     pa.ListArray.from_arrays(offsets, pa.array(sums[p][used].ravel()))], names=["part", "entry", "sums"])

    got = flat.select("part", "n", "x", "low", "high", "total").mapInArrow(run, "part int, entry int, sums array<long>")
    added = got.select("part", "entry", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"))
    out = [np.zeros((len(c), width + 1), np.int64) for c in books]
    for r in added.collect():  # entries x (dimension + parts) numbers at most
        out[r["part"]][r["entry"], r["at"]] = r["s"]
    return [np.where(o[:, -1:] > 0, o[:, :-1] // np.maximum(o[:, -1:], 1), c) for o, c in zip(out, books, strict=True)]


def _assign(flat: DataFrame, books: list[np.ndarray], exact: bool) -> DataFrame:
    """(rid, part, code, error) of every part."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for p, rids, x, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                near = shortlist(_ints(low, width)[0], _ints(high, width)[0], books[p])
                best, d = nearest(_ints(x, width), books[p][near], exact)
                for o, a in zip(out, (np.frombuffer(rids, "<i8"), np.full(len(d), p, np.int32), near[best].astype(np.int32), d), strict=True):
                    o.append(a)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["rid", "part", "code", "error"])

    return flat.select("part", "rids", "x", "low", "high").mapInArrow(run, "rid long, part int, code int, error long")


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for c in books for v in c.ravel().tolist()).encode()).hexdigest()


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
          key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, codes array<int>, error)`` of every vector that takes part, and the codebooks."""
    spark = vectors.sparkSession
    prepare(spark, 2048)
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = cut_lineage(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    first = rows.orderBy(*order).select(F.size("v").alias("n")).first()
    shape = "vec_id long, label " + rows.schema["label"].dataType.simpleString() + ", codes array<int>, error long"
    if first is None:
        return spark.createDataFrame([], shape), [np.zeros((0, 0), np.int64)] * parts
    dim = first["n"]
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == dim)
    start = np.array([r["v"] for r in rows.orderBy(*order).limit(entries).select("v").collect()], np.float64)
    got = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.var_pop("x").alias("var")).orderBy("at").collect()  # a row a component
    largest = max(max(abs(r["low"]), abs(r["high"])) for r in got) * scale + 1
    width = dim // parts
    if 4.0 * width * largest * largest >= 2.0**62:
        raise ValueError("components are too large for exact 64-bit distances")
    exact = 4.0 * width * largest * largest < 2.0**52
    stats = {k: np.floor(np.array([r[k] for r in got]) * scale).astype(np.int64) for k in ("low", "high")}
    stats["var"] = np.array([r["var"] for r in got])
    flat = blocks(rows, stats, dim, parts, scale)
    seed = np.floor(start * scale).astype(np.int64)
    books = [np.ascontiguousarray(seed[:, p * width : (p + 1) * width]) for p in range(parts)]
    for _ in range(rounds):
        books = _round(flat, books, exact)
    found = _assign(flat, books, exact).groupBy("rid").agg(
        F.sum("error").alias("error"),
        F.array(*[F.max(F.when(F.col("part") == p, F.col("code"))) for p in range(parts)]).alias("codes"))
    return rows.select("rid", "vec_id", "label").join(found, "rid").select("vec_id", "label", "codes", "error"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of its label added up (null labels together)."""
    coded = cut_lineage(coded, "codes")
    total = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(broadcast_if(cut_lineage(total, "label-errors"), LABELS), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
