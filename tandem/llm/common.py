"""Small helpers of this package: appended columns, Arrow batch size, checked broadcasts, connected classes."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.session import cut_lineage

BATCH_ROWS = 512
TOKENIZERS = "/opt/tokenizers"
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python runs in tasks: workers get this package, and Arrow hands them few rows at once, as texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="tandem-code-"), "tandem.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for n in names:
                    if n.endswith(".py"):
                        f = os.path.join(folder, n)
                        z.write(f, os.path.relpath(f, os.path.dirname(package)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)


def append_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[], Callable]) -> DataFrame:
    """``df`` with columns that ``fn()`` (called once a task) makes of each Arrow batch.

    A column of ``df`` that has the name of a new one is replaced.
    """
    prepare(df.sparkSession)
    base = df.drop(*[f.name for f in fields])
    out = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fn()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *make(b)], names=out.names)

    return base.mapInArrow(run, out)


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` (a written table) has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``rows`` rows, else for a sort-merge join, which spills."""
    return F.broadcast(df) if within(df, rows) else df.hint("merge")


def smallest_reachable(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """``(node, root)``: the smallest node that each node of ``links`` reaches, over links in either direction.

    Alternates large-star and small-star steps (links that lead to smaller
    nodes only), each written to the shared folder. Hot nodes are safe: minima
    are combined before the shuffle and joins on a hot node can be split. Nulls
    link nothing. The number of rounds grows with the logarithm of the longest
    chain.
    """
    e = cut_lineage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct(),
        name,
    )
    while True:
        # large star: each larger neighbour of u links to the smallest neighbour of u (u included)
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where(F.col("y") > F.col("x")).join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l"))
        new = cut_lineage(small.select("l.u", "l.v").where(F.col("u") != F.col("v")).distinct(), name)
        if new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and _stars(new):
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                new.select("v", "v").distinct())
        e = new


def _stars(e: DataFrame) -> bool:
    return e.groupBy("u").count().where("count > 1").isEmpty()
