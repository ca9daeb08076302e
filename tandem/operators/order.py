"""Row-position operators: dense indexes, positional splits, unions, caps.

The reference gives meaning to row position (split points, first-seen ids, log
ids). A global ``row_number()`` would pull every row into one task, so the
index is made of sampled ranges of the whole order key:

1. rows are dealt by ranges of the key (Spark samples the bounds, so ranges have
   like numbers of rows whatever the key's type and however it clusters), sorted
   inside their range and written with their rank there,
2. the number of rows of each range (a row a range) is summed up,
3. the sum of all ranges before is added to each rank.

The input is computed once, and no task sorts more than one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.common import as_col
from tandem.session import bounded_broadcast, cut_lineage

RANK_BITS = 33              # fixed value: monotonically_increasing_id() holds the rank in its lower bits
GROUP_ROWS = 1_000_000      # rows of a table of ranges or groups that may be broadcast


def _cols(xs) -> list[Column]:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        xs = [xs]
    return [as_col(x) for x in xs]


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL, so that no row is lost."""
    renamed = right.withColumnsRenamed({k: f"{k}_right" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_right"))
    return left.join(bounded_broadcast(renamed, GROUP_ROWS)[0], cond).drop(*[f"{k}_right" for k in keys])


def dense_index(
    df: DataFrame,
    order: Sequence,
    partition_by: Sequence | None = None,
    start: int = 0,
    name: str = "idx",
    total: str | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Consecutive index of ``df`` in ``order`` (ascending), from ``start``.

    With ``partition_by`` the index restarts per partition. With ``total`` the
    row count of the partition is attached under that name. Rows with NULL keys
    or partitions keep their place (NULL first). Rows of one key share a range, so
    a key should tell rows apart; ties stand in any order. Columns in ``drop`` are not kept.
    """
    part = _cols(partition_by)
    pnames = [f"_p{i}" for i in range(len(part))]
    onames = [f"_o{i}" for i in range(len(_cols(order)))]
    kept = [F.col(c) for c in df.columns if c not in drop]
    keyed = df.select(*kept, *[c.alias(n) for c, n in zip(part, pnames)], *[c.alias(n) for c, n in zip(_cols(order), onames)])
    dealt = keyed.repartitionByRange(*pnames, *onames).sortWithinPartitions(*pnames, *onames).drop(*onames)
    ranked = cut_lineage(dealt.withColumn("_m", F.monotonically_increasing_id()), "ranked")
    ranked = ranked.withColumns({"_range": F.shiftright("_m", RANK_BITS), "_r": F.col("_m").bitwiseAND((1 << RANK_BITS) - 1)}).drop("_m")
    sizes = ranked.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = cut_lineage(sizes.select("_range", before.alias("_base")), "ranges")
    out = ranked.join(bounded_broadcast(bases, GROUP_ROWS)[0], "_range").withColumn("_place", F.col("_base") + F.col("_r")).drop("_range", "_r", "_base")
    if not part:
        if total:
            out = out.withColumn(total, F.lit(ranked.count()).cast("long"))
        return out.withColumn(name, (F.col("_place") + F.lit(start)).cast("long")).drop("_place")
    groups = cut_lineage(out.groupBy(*pnames).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias(total or "_total")), "groups")
    out = _join_null_safe(out, groups if total else groups.drop("_total"), pnames).withColumn(
        name, (F.col("_place") - F.col("_first") + F.lit(start)).cast("long"))
    return out.drop(*pnames, "_place", "_first")


def split_ordered(
    df: DataFrame, order: Sequence = ("sid",), train: tuple[int, int] = (9, 10),
    valid: tuple[int, int] = (95, 100), partition_by=None, name: str = "split",
) -> DataFrame:
    """Contiguous train / valid / test split by row order.

    train = ``[0, n*9 div 10)``, valid = ``[n*9 div 10, n*95 div 100)``, test
    the rest — integer arithmetic, as ``int(n * 0.9)`` gives for the sizes in
    use.
    """
    ix = dense_index(df, order, partition_by=partition_by, name="_i", total="_t")
    a = F.floor(F.col("_t") * train[0] / train[1])
    b = F.floor(F.col("_t") * valid[0] / valid[1])
    return ix.withColumn(
        name,
        F.when(F.col("_i") < a, F.lit("train")).when(F.col("_i") < b, F.lit("valid")).otherwise(F.lit("test")),
    ).drop("_i", "_t")


def split_half(df: DataFrame, order: Sequence = ("sid",), partition_by=None,
               name: str = "split") -> DataFrame:
    """First ``int(n * 0.5)`` rows → valid, the rest → test."""
    ix = dense_index(df, order, partition_by=partition_by, name="_i", total="_t")
    return ix.withColumn(
        name, F.when(F.col("_i") < F.floor(F.col("_t") / 2), F.lit("valid")).otherwise(F.lit("test"))
    ).drop("_i", "_t")


def reindex_regions(df: DataFrame, region: str = "region", order: str = "sid", name: str = "sid") -> DataFrame:
    """All regions of one frame, re-indexed in (region, old order) order from 0."""
    u = df.withColumnRenamed(order, "_old")
    ix = dense_index(u, [region, "_old"], name=name)
    return ix.drop("_old")


def union_regions(*dfs: DataFrame, order: str = "sid", name: str = "sid") -> DataFrame:
    """UNION ALL of frames, re-indexed in (frame, old order) order from 0."""
    parts = [d.withColumn("_part", F.lit(i)) for i, d in enumerate(dfs)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return reindex_regions(u, "_part", order, name).drop("_part")


def cap_per_group(df: DataFrame, group: Sequence, order: Sequence, n: int = 600) -> DataFrame:
    """Keep the rows of the first ``n`` distinct ``order`` keys of every group.

    The ranking runs on distinct (group, order) keys; ``row_number() <= n`` lets
    Spark insert a partial per-group limit before the shuffle, so a hot group
    sends at most ``n`` keys per map task. Rows are then kept by a left-semi
    join on the kept keys (at most ``n`` per group).
    """
    gcols, ocols = list(group), list(order)
    keys = df.select(*gcols, *ocols).distinct()
    w = Window.partitionBy(*gcols).orderBy(*ocols)
    kept = keys.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return df.join(kept, gcols + ocols, "left_semi")


def head_rows(df: DataFrame, n: int = 100, order: Sequence = ("sid",)) -> DataFrame:
    """First ``n`` rows in input order (top-k: per-partition heads, then merge)."""
    return df.orderBy(*order).limit(n)
