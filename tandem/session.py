"""Session helpers: a local session for tests and benches, and the shared
checkpoint folder used to cut lineage of iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
SHUFFLES_END = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}   # what a write has exchanged is deleted when it ends


def local_session(cores: int = 8, partitions: int | None = None, app: str = "tandem") -> SparkSession:
    """A ``local[cores]`` session configured the way the tests and bench expect."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir`` (or a directory already set on the
    context). Only a local-mode session without one gets a fresh folder of its
    own; a cluster session without it is an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover - conf lookup differs by mode
            d = None
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="tandem-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/tandem-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage", codec: str = "snappy") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back: the plan below it is cut, and a lost executor re-reads
    the table instead of recomputing the lineage."""
    path = scratch_path(df.sparkSession, name)
    with session_conf(df.sparkSession, **SHUFFLES_END):
        df.write.mode("overwrite").parquet(path, compression=codec)
    out = df.sparkSession.read.parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that :func:`cut_lineage` wrote and that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(conf).delete(path, True)


def bucketed_table(df: DataFrame | list[DataFrame], n: int, key: str, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` (or several, one after the other) written once as a table of ``n`` buckets of ``key`` in the shared folder.

    Joins of such tables on ``key`` need no exchange of either side. Rows are written where they are made, a file
    for each bucket that a task has rows of: for few rows a task (blocks), or rows that lie in buckets already.
    """
    parts = df if isinstance(df, list) else [df]
    spark, path = parts[0].sparkSession, scratch_path(parts[0].sparkSession, name)
    table = "tandem_" + uuid.uuid4().hex
    with session_conf(spark, **SHUFFLES_END):
        for part in parts:
            part.write.bucketBy(n, key).options(**(options or {})).option("path", path).mode("append").saveAsTable(table)
    return spark.table(table)


@contextmanager
def session_conf(spark: SparkSession, **conf: str) -> Iterator[None]:
    """While it is open the session has these settings; what it had before comes back after it.

    For jobs that run inside: a plan that runs later is planned with the settings of that time.
    """
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ship_package(spark: SparkSession) -> None:
    """Workers get this package before Python runs in tasks (code alone, no data)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tandem-code-"), "tandem-core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    f = os.path.join(folder, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(package)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def bounded_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when it provably holds at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows, so it is cheap on a
    materialised (checkpointed) table. Beyond the bound the join is pinned to
    sort-merge, which spills and whose skewed partitions AQE splits.
    """
    from pyspark.sql import functions as F

    n = df.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(df), True
    # too large to ship to every executor: keep the planner from broadcasting
    # it on a (possibly stale) size estimate
    return df.hint("merge"), False


def spread(df: DataFrame, *cols) -> DataFrame:
    """Hash-repartition a scan that yields fewer partitions than the cluster
    can run at once (e.g. one large row group); a no-op for wide inputs."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        narrow = df.rdd.getNumPartitions() < target
    except Exception:  # no RDD view of the plan (e.g. a remote session): leave it to AQE
        return df
    return df.repartition(target, *cols) if narrow else df


def repeated_keys(df: DataFrame, key: str) -> DataFrame | None:
    """``_again``: the keys that more than one row has, and NULL where a row has none; none where there are none. Only keys are exchanged."""
    from pyspark.sql import functions as F

    again = df.groupBy(F.col(key).alias("_again")).count().where((F.col("count") > 1) | F.col("_again").isNull()).select("_again", F.lit(True).alias("_met"))
    again = cut_lineage(again, "repeated-keys")
    return None if again.isEmpty() else again


def apart(df: DataFrame, key: str, bound: int = 1_000_000) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose ``key`` no other row has, and the others (with those that have none; none where there are none).

    Only the keys are exchanged. What is done by key needs no exchange of the first.
    """
    from pyspark.sql import functions as F

    again = repeated_keys(df, key)
    if again is None:
        return df, None
    marked = df.join(bounded_broadcast(again, bound)[0], F.col(key).eqNullSafe(F.col("_again")), "left")
    return tuple(marked.where(F.col("_met").isNull() if alone else F.col("_met")).drop("_again", "_met") for alone in (True, False))
