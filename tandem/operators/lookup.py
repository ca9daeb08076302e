"""Arrays of a row looked up in a table, element by element.

The table's frequent entries go to the workers, which look up whole rows in Arrow and write them in blocks of rows,
into the bucket of the block. What the entries lack is exploded with its place in the block and joined with the other
entries; only the values found are exchanged, by block. Rows are written once and never exchanged.
Only rows that share a key are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.common import as_col
from tandem.session import bounded_broadcast, bucketed_table, cut_lineage, repeated_keys, ship_package

HEAD_ROWS = 1 << 20         # entries of a table that go to the workers
BATCH_ROWS = 1 << 18        # rows that are looked up together, at least,
BATCH_ELEMENTS = 1 << 21    # or elements: either number is enough
BLOCK_ELEMENTS = 1 << 18    # elements of a block of rows, about
BLOCK_OPTIONS = {"compression": "zstd", "parquet.enable.dictionary": "false"}     # numbers of frequent entries are small
DOUBLED_ROWS = 1_000_000    # names held more than once that may be broadcast


def joined_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, elements: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows`` (or with as many ``elements`` in the lists of the last column), but for the last."""
    held, n, m = [], 0, 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        m += len(b.column(b.num_columns - 1).flatten()) if elements is not None else 0
        if n >= rows or (elements is not None and m >= elements):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, m = [], 0, 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def flat_lists(col: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(number of elements of each row, all elements); a missing list has none."""
    return pc.fill_null(pc.list_value_length(col), 0).to_numpy(), col.flatten()


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(_offsets(sizes), values)


def head_bound(known: DataFrame, rows: int) -> int | None:
    """The least ``freq`` at which no more than ``rows`` rows are as frequent; one row a frequency comes to the driver."""
    least, n = None, 0
    for r in known.groupBy("freq").count().orderBy(F.desc("freq")).limit(rows + 1).collect():
        n += r["count"]
        if n > rows:
            break
        least = r["freq"]
    return least


def _parts(table: DataFrame, name: str, value: str, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The entries (name, value, freq) for the workers, and the others; none where nothing is left.

    Entries of a name that the table holds more than once are among the others.
    """
    freq = F.col("freq").cast("long") if "freq" in table.columns else F.lit(0).cast("long")
    known = cut_lineage(table.where(F.col(name).isNotNull() & F.col(value).isNotNull()).select(name, value, freq.alias("freq")), "lookup", "zstd")
    # names are told apart by their hashes first: hardly any is held twice, and the hashes are all that is exchanged
    code, twice = F.xxhash64(name), None
    met = cut_lineage(known.groupBy(code.alias("_code")).count().where("count > 1").select("_code"), "met")
    if not met.isEmpty():
        held = known.join(bounded_broadcast(met, DOUBLED_ROWS)[0], code == F.col("_code"), "left_semi").groupBy(name).agg(
            F.count(F.lit(1)).alias("n"), F.max("freq").alias("_freq"))
        twice = cut_lineage(held.where("n > 1").select(F.col(name).alias("_twice"), "_freq"), "doubled")
        known = known.join(bounded_broadcast(twice, DOUBLED_ROWS)[0], F.col(name) == F.col("_twice"), "left").withColumn("freq", F.coalesce("_freq", "freq"))
    if known.limit(rows + 1).count() <= rows:
        first = F.lit(True)
    else:
        least = head_bound(known, rows)
        first = F.coalesce(F.col("freq") >= least, F.lit(False)) if least is not None else F.lit(False)
    if twice is not None:
        first = first & F.col("_twice").isNull()
    others = known.where(~first).select(name, value)
    return known.where(first).select(name, value, "freq"), None if others.isEmpty() else others


def _put_in(values: pa.Array, sizes: np.ndarray, at: np.ndarray, fills: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(values, sizes, how often each stands there) with the elements at ``at`` (ascending) replaced by ``fills``; several of one place all stand there."""
    n = np.ones(len(values), np.int64)
    if not len(at):
        return values, sizes, n
    lacks, first, met = np.unique(at, return_index=True, return_counts=True)
    start = np.arange(len(values))
    start[lacks], n[lacks] = first + len(values), met
    if met.max() > 1:
        ends = np.cumsum(n)
        start = np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]))
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), n, minlength=len(sizes)).astype(np.int64)
    return pa.concat_arrays([values, fills.cast(values.type)]).take(pa.array(start)), sizes, n


def _in_order(at: np.ndarray, fills: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sorted by place, and by value where several have one place."""
    order = np.argsort(at, kind="stable")
    if len(at) and (np.diff(at[order]) == 0).any():
        order = pc.sort_indices(pa.table({"at": at, "v": fills}), sort_keys=[("at", "ascending"), ("v", "ascending")]).to_numpy()
    return at[order], fills.take(pa.array(order))


def looked_up(df: DataFrame, items, table: DataFrame, name: str, value: str, missing: Callable[[pa.Array, np.ndarray, np.ndarray, pa.Array | None], pa.Array],
              key: str, out: str, rows: int = HEAD_ROWS, beside: Column | None = None) -> DataFrame:
    """``(key, out)``: each element of ``items`` replaced by its ``value`` in ``table(name, value[, freq])``.

    ``missing(t, p, row, c)`` gives the values of what the table lacks: the elements ``t``, their positions ``p`` and their rows'
    numbers ``row`` in ``c``, the column ``beside`` of the rows looked up together. A row a key: rows of one
    key are merged by position, elements of a name with several values give all of them.

    Rows are written once, in blocks, with numbers rather than text where either side is one, and are not exchanged:
    the values of their rarer elements come to the blocks.
    """
    spark = df.sparkSession
    ship_package(spark)
    few, others = _parts(table, name, value, rows)
    src = df.select(key, *([beside.alias("_c")] if beside is not None else []), as_col(items).alias("_t"))
    kind, to = src.schema["_t"].dataType.elementType, table.schema[value].dataType
    got = few.select(F.col(name).cast(kind), value, "freq").toArrow().sort_by([("freq", "descending")])
    sent = spark.sparkContext.broadcast((got[0].combine_chunks(), got[1].combine_chunks()))
    has_c = beside is not None
    block, whole_number = f"{key}_block", T.ArrayType(T.IntegerType())
    fields = T.StructType([
        T.StructField(block, T.LongType()), T.StructField("_k", T.ArrayType(src.schema[key].dataType)), T.StructField("_n", whole_number),
        # an element is its entry's number till it is used; what has none: place in the block, element, value that stands for it
        T.StructField("_v", whole_number), T.StructField("_p", whole_number), T.StructField("_t", T.ArrayType(kind)), T.StructField("_d", T.ArrayType(to))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = sent.value
        number = TaskContext.get().partitionId() << 32
        for b in joined_batches(batches, BATCH_ROWS, BATCH_ELEMENTS):
            sizes, flat = flat_lists(b.column(b.num_columns - 1))
            at = pc.index_in(flat, value_set=names.cast(flat.type))
            lacks = pc.is_null(at)
            ends = np.cumsum(sizes)
            starts, place = ends - sizes, np.flatnonzero(lacks.to_numpy(zero_copy_only=False))
            row = np.searchsorted(ends, place, "right")
            rest = flat.filter(lacks)
            stand = missing(rest, place - starts[row], row, b.column(1) if has_c else None).cast(values.type)
            first = np.flatnonzero(np.diff(starts // BLOCK_ELEMENTS, prepend=-1))
            in_rows, in_elements = np.append(first, b.num_rows), np.append(starts[first], len(flat))
            in_rest = np.searchsorted(place, in_elements)
            cut = lambda bounds, a: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), a)
            own = (place - np.repeat(in_elements[:-1], np.diff(in_rest))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(len(first))), cut(in_rows, b.column(0)), cut(in_rows, pa.array(sizes.astype(np.int32))),
                 cut(in_elements, at.cast(pa.int32())), cut(in_rest, pa.array(own)), cut(in_rest, rest), cut(in_rest, stand)], names=fields.names)
            number += len(first)

    def put_in(places: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = sent.value[1]
            for b in batches:
                sizes = b.column("_n").flatten().to_numpy()
                in_block, v = flat_lists(b.column("_v"))
                base = np.cumsum(in_block) - in_block
                n, p = flat_lists(b.column("_p"))
                lacks = np.zeros(len(v), bool)
                lacks[np.repeat(base, n) + p.to_numpy()] = True
                v = pc.replace_with_mask(values.take(v), pa.array(lacks), b.column("_d").flatten())
                place = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                met = np.ones(len(v), np.int64)
                if "_f" in b.schema.names:
                    n, fills = flat_lists(b.column("_f"))
                    v, sizes, met = _put_in(v, sizes, *_in_order(np.repeat(base, n) + fills.field("_p").to_numpy(), fills.field("v")))
                yield pa.RecordBatch.from_arrays(
                    [b.column("_k").flatten(), _lists(v, sizes), *([_lists(pa.array(np.repeat(place, met).astype(np.int32)), sizes)] if places else [])],
                    names=[key, out, *(["_at"] if places else [])])
        return run

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed_table(src.mapInArrow(split, fields), buckets, block, "looked-up", BLOCK_OPTIONS)
    given = blocks.drop("_t")
    if others is not None:
        lacking = blocks.select(block, F.explode(F.arrays_zip("_p", "_t")).alias("x")).select(block, "x._p", "x._t").where(F.col("_t").isNotNull())
        found = lacking.join(others.select(F.col(name).cast(kind).alias("_t"), F.col(value).alias("v")).hint("shuffle_hash"), "_t").select(block, "_p", "v")
        fills = found.repartition(buckets, block).groupBy(block).agg(F.collect_list(F.struct("_p", "v")).alias("_f"))
        given = given.join(fills.hint("shuffle_hash"), block, "left")
    given = given.drop(block)
    result = T.StructType([src.schema[key], T.StructField(out, T.ArrayType(to))])
    whole = given.mapInArrow(put_in(False), result)
    again = repeated_keys(blocks.select(F.explode("_k").alias(key)), key)
    if again is None:
        return whole
    again = bounded_broadcast(again, DOUBLED_ROWS)[0]
    same = F.col(key).eqNullSafe(F.col("_again"))
    shared = given.mapInArrow(put_in(True), T.StructType([*result.fields, T.StructField("_at", whole_number)])).join(again, same, "left_semi")
    merged = shared.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("_at", out)))).alias("_x"))
    return whole.join(again, same, "left_anti").union(merged.select(key, F.transform("_x", lambda x: x[out]).alias(out)))
