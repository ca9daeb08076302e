"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt out by ranges of their id and sorted, encoded, and written
by Spark's ORC writer, so that the files hold them in ascending order (run-length
encoded ids gain little from a compressor, so there is none). A row is
``(doc_id, shard, first, n_tokens, ids)``: ``shard`` is the writing task and
``first`` counts the ids before the row in it. Readers take the stripes of a
file in parallel; a filter on ``doc_id`` skips stripes and row groups by their
statistics and Bloom filters. The ids before a document in all files are the
totals of earlier shards (one number a shard) plus ``first``.

Defined results: a null text counts as empty; null ids come first; rows that
repeat an id stand next to each other, in the order of a hash of their text;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm.common import broadcast_if, prepare
from tandem.llm.encoders import hf_encoder, pack_ids

STRIPE_BYTES, INDEX_ROWS, FPP = 16 << 20, 1000, 0.01
SCHEMA = "doc_id long, shard int, first long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes whole texts, each followed by ``end_id``, and writes them to ``path`` in ascending order of ``key``."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    tie = F.xxhash64("text")
    src = src.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    end = pack_ids([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, first = hf_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            got = [encode(t) + end for t in b.column(1).to_pylist()]
            n = np.array([len(g) // 4 for g in got], np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(first + ends[:-1]), pa.array(n),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(got), "<i4"))),
            ], names=["doc_id", "shard", "first", "n_tokens", "ids"])
            first += int(ends[-1])

    out = src.mapInArrow(run, SCHEMA)
    (out.write.option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_ROWS)
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", FPP).option("compression", "none").orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files with ``start``, the ids of all documents before; ``doc_ids``: only those, by index and Bloom filter."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("shard", before.alias("base"))  # one row a file
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(broadcast_if(bases, 200_000), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base", "first", "shard")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``ids_crc32`` (unsigned, of little-endian unsigned 32-bit ids) in place of ``ids``."""
    prepare(tokens.sparkSession)
    rest = [f for f in tokens.schema.fields if f.name not in ("ids", "ids_crc32")]
    src = tokens.select(*[f.name for f in rest], "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.num_columns - 1)
            flat = memoryview(col.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False).view(np.uint8))
            ends = np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) * 4
            crcs = [zlib.crc32(flat[s:e]) for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crcs, pa.int64())], names=[*(f.name for f in rest), "ids_crc32"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ids_crc32 long"])
    return src.mapInArrow(run, kinds)
