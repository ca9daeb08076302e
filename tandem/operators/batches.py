"""Matrix cells, length-bucketed batches and batch padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.arrays import pad_to
from tandem.functions.common import PAD_ID, as_col
from tandem.operators.order import dense_index


def matrix_cells(df: DataFrame, row: str, vec, value: str = "value") -> DataFrame:
    """A matrix stored as one array per row → ``(row, col, value)`` cells."""
    return df.select(F.col(row).alias("row"), F.posexplode(as_col(vec)).alias("col", value)) \
        .withColumn("col", F.col("col").cast("long"))


def top_n_cells(cells: DataFrame, n: int, value: str = "value") -> DataFrame:
    """The ``n`` largest cells, descending; ties by (row, col)."""
    return cells.orderBy(F.desc(value), F.asc("row"), F.asc("col")).limit(n)


def one_hot_cells(df: DataFrame, ids, key: str = "sid") -> DataFrame:
    """Sparse one-hot form: one ``(key, pos, id)`` row per set bit."""
    return df.select(key, F.posexplode(as_col(ids)).alias("pos", "id"))


def bucket_batches(df: DataFrame, length, batch_size: int, key: str = "sid") -> DataFrame:
    """Sentences of like source length share a batch; longest first inside.

    Order ``(length, key)`` → dense index → ``batch = idx div batch_size`` →
    rank inside the batch by length desc, key asc (a batch holds at most
    ``batch_size`` rows).
    """
    d = df.withColumn("_len", as_col(length).cast("long"))
    ix = dense_index(d, ["_len", key], name="_i")
    b = ix.withColumn("batch", F.floor(F.col("_i") / batch_size).cast("long"))
    w = Window.partitionBy("batch").orderBy(F.desc("_len"), F.asc(key))
    return b.withColumn("rank_in_batch", F.row_number().over(w).cast("long")).drop("_i", "_len")


def pad_batch(df: DataFrame, ids, batch: str = "batch", pad: int = PAD_ID, out: str | None = None) -> DataFrame:
    """Right-pad every id array to the longest one of its batch."""
    out = out or (ids if isinstance(ids, str) else "padded")
    m = F.max(F.size(as_col(ids))).over(Window.partitionBy(batch))
    return df.withColumn(out, pad_to(as_col(ids), m, pad))
