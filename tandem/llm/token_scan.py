"""Token counts by a separator scan of flat token files without an index.

A flat file is nothing but unsigned 16- or 32-bit ids; documents end with an
end-of-document id. Files are scanned in blocks, each a task's byte range:

1. every block searches its ids for the separator at once (numpy) and reports
   how many it has and where the last one is;
2. a prefix scan over the blocks of a file (a window of one row a block) gives
   each block the place of the last separator before it and the number of
   documents that end before it;
3. every block is searched again and reports its documents, the first of which
   may have begun blocks earlier.

No row of a document is shuffled between blocks. Files are opened through
``pyarrow.fs``, so the folder can be any shared store; writers put a file in
place by one rename, so a task that runs again replaces it by the same bytes.

Defined results: the separator's string in a text is ordinary text; null and empty texts are documents of no ids; ids behind the
last separator of a file are a document with ``terminated`` false; empty files
and tables give nothing; further columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm.common import prepare
from tandem.llm.encoders import hf_encoder, pack_ids
from tandem.session import cut_lineage

BLOCK_IDS = 2 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
    elif path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Encodes whole texts into one flat file per task (``width`` bytes an id); gives ``(key, file, ordinal)`` of each document."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = src.schema[0].dataType.simpleString()
    end, stored = pack_ids([end_id]), f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, name = hf_encoder(tokenizer, spelled=True), f"part-{TaskContext.get().partitionId():06d}.bin"
        store, folder = open_store(path)
        store.create_dir(folder)
        written, temp = 0, f"{folder}/_{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as out:
            for b in batches:
                ids = np.frombuffer(b"".join([encode(t) + end for t in b.column(1).to_pylist()]), "<u4")
                if len(ids) and int(ids.max()) >= 1 << (8 * width):
                    raise ValueError(f"an id does not fit in {width} bytes")
                out.write(ids.astype(stored).tobytes())
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * n), pa.array(np.arange(written, written + n))],
                                                 names=[key, "file", "ordinal"])
                written += n
        if written:
            store.move(temp, f"{folder}/{name}")
        else:
            store.delete_file(temp)

    return cut_lineage(src.mapInArrow(run, f"`{key}` {kind}, file string, ordinal long"), "flat")


def _blocks(spark: SparkSession, path: str, width: int, block_ids: int) -> DataFrame:
    store, folder = open_store(path)
    files = [(f.base_name, f.size // width) for f in store.get_file_info(fs.FileSelector(folder))
             if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    df = spark.createDataFrame([f for f in files if f[1]], "file string, ids long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("ids") - 1, F.lit(block_ids).cast("long"))).alias("at")
    return df.select("file", "ids", at).repartition("file", "at")


def _read(store: fs.FileSystem, folder: str, name: str, at: int, n: int, width: int) -> np.ndarray:
    with store.open_input_file(f"{folder}/{name}") as f:
        f.seek(at * width)
        return np.frombuffer(f.read(n * width), f"<u{width}")


def scan(spark: SparkSession, path: str, end_id: int, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``(file, ordinal, start, n_tokens, terminated)`` of each document in the flat files of ``path``; separators don't count."""
    prepare(spark)
    blocks = _blocks(spark, path, width, block_ids)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        for b in batches:
            counts, lasts = [], []
            for name, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                ends = np.flatnonzero(_read(store, folder, name, at, block_ids, width) == end_id)
                counts.append(len(ends))
                lasts.append(at + int(ends[-1]) if len(ends) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(lasts, pa.int64())],
                                             names=["file", "ids", "at", "n", "last"])

    seen = cut_lineage(blocks.mapInArrow(summary, "file string, ids long, at long, n long, last long"), "blocks")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select("file", "ids", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"),
                          (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("begin"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        for b in batches:
            for name, ids, at, ordinal, begin in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ends = at + np.flatnonzero(_read(store, folder, name, at, block_ids, width) == end_id)
                starts = np.concatenate(([begin], ends + 1))
                whole = np.ones(len(ends), bool)
                if at + block_ids >= ids and starts[-1] < ids:  # what stands behind the file's last separator
                    ends, whole = np.append(ends, ids), np.append(whole, False)
                starts = starts[: len(ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ends), pa.string()), pa.array(ordinal + np.arange(len(ends))), pa.array(starts.astype(np.int64)),
                     pa.array((ends - starts).astype(np.int64)), pa.array(whole)],
                    names=["file", "ordinal", "start", "n_tokens", "terminated"])

    return carried.mapInArrow(documents, "file string, ordinal long, start long, n_tokens long, terminated boolean")
