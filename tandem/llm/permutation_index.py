"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots in order. Index rows
are dealt over blocks; in each block the pivots' inverted files hold the place
of the pivot in each vector's order (dense: a pivot is in the prefix of a
quarter of the vectors). A query walks the files of its own pivots and adds up ``min(m - a, m - b)`` for places a and b: up to a constant this is
Spearman's footrule between the two prefixes, pivots outside a prefix standing
at its end. The ``SHARE`` best of a block, and all that score as the last of them,
are reranked by the exact inner product in double precision, and the best of all
blocks are merged.

Copies of a vector are one row of the index, with the smallest ``k + 1`` of their
ids: after reranking a copy can only be an answer when fewer than ``k`` smaller
ids share its vector, so no other id is ever needed.

Largest inner product becomes nearest direction by one more component that
lifts every indexed vector to the same norm (queries have zero there).

Pivots: ``PIVOTS`` distinct vectors from the smallest hashes of their smallest ids
(the bounded sample); every vector is indexed. Queries are a stated set, also in blocks; a group is
one block of each. Recall against brute force is measured in the tests and by
:func:`audit_recall`.

Defined results: vectors that are null, empty, zero, of another dimension than
the pivots or hold null or non-finite components take no part, nor do null
ids; rows that repeat an id and vector count once; with fewer candidates than
``k`` all are returned; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import prepare
from tandem.session import cut_lineage

PIVOTS, PREFIX, SHARE = 512, 128, 0.2
INDEX_BLOCK, QUERY_BLOCK = 8192, 8192


def valid_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v)`` of the rows that take part, components as doubles, repeats once."""
    v = F.col("v")
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall(
            v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)).distinct()


def matrix(col) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in col]) if len(col) else np.zeros((0, 1))


def _orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
    return np.concatenate((x, rest[:, None]), axis=1)


def search_block(ids: list[np.ndarray], x: np.ndarray, qids: np.ndarray, q: np.ndarray, pivots: np.ndarray, norm: float, k: int,
                 share: float = SHARE, prefix: int = PREFIX) -> pd.DataFrame:
    """Each query's best ``k`` ids of one block; ``ids``: the smallest ids of each distinct vector, in order."""
    n, m = len(x), min(prefix, len(pivots))
    order = _orders(_lift(x, norm), pivots, m)
    # inverted files: for each pivot the places it has in the orders, 0 where it isn't in a prefix
    files = np.zeros((len(pivots), n), np.uint16)
    files[order, np.arange(n)[:, None]] = m - np.arange(m, dtype=np.uint16)
    qorder = _orders(np.concatenate((q, np.zeros((len(q), 1))), axis=1), pivots, m)
    take = min(n, max(50 * k, int(np.ceil(share * n))))
    own = (m - np.arange(m, dtype=np.uint16))[:, None]  # at most m * m / 2 in all: fits in 16 bits
    none = np.iinfo(np.int64).max
    first = np.array([v[0] for v in ids], np.int64)
    second = np.array([v[1] if len(v) > 1 else none for v in ids], np.int64)
    out = []
    for i in range(len(q)):
        score = np.add.reduce(np.minimum(files[qorder[i]], own), axis=0, dtype=np.uint16)
        near = np.flatnonzero(score >= np.partition(score, n - take)[n - take]) if take < n else np.arange(n)
        low = np.where(first[near] == qids[i], second[near], first[near])  # the smallest id that isn't the query's
        near, low = near[low < none], low[low < none]
        exact = x[near] @ q[i]
        best = np.lexsort((low, -exact))
        # as many vectors as have k ids between them: an id may have several vectors
        fresh = np.sort(np.unique(low[best], return_index=True)[1])
        best = best[: fresh[k - 1] + 1] if len(fresh) > k else best
        lists = [ids[j] for j in near[best]]
        found, s = np.concatenate([np.zeros(0, np.int64), *lists]), np.repeat(exact[best], [len(v) for v in lists])
        found, s = found[found != qids[i]], s[found != qids[i]]
        best = np.lexsort((found, -s))
        best = best[np.sort(np.unique(found[best], return_index=True)[1])[:k]]
        out.append(pd.DataFrame({"query_id": qids[i], "vec_id": found[best], "score": s[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
           pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` nearest found among all rows of ``index`` with another id."""
    spark = index.sparkSession
    prepare(spark)
    # a rank that ends at k + 1 is cut in each task before the shuffle: a hot vector sends few ids
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = valid_vectors(index, key, vector).withColumn("place", place).where(F.col("place") <= k + 1)
    rows = cut_lineage(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "index")
    asked = cut_lineage(valid_vectors(queries, key, vector), "queries")
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0], "v").limit(pivots).collect()]
    n, nq = rows.count(), asked.count()
    if not chosen or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(chosen[0])
    chosen = [v for v in chosen if len(v) == dim]
    fits = F.size("v") == dim
    top = rows.where(fits).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    norm = float(np.sqrt(top))
    piv = _lift(matrix(chosen), norm)
    piv = spark.sparkContext.broadcast(piv / np.linalg.norm(piv, axis=1, keepdims=True))
    blocks, chunks = -(-n // INDEX_BLOCK), -(-nq // QUERY_BLOCK)
    side = rows.where(fits).select("ids", "v", F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("i"),
                                   F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("j"))
    ask = asked.where(fits).select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("i"),
                                   F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("j"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block([np.asarray(v, np.int64) for v in a["ids"]], matrix(a["v"]), b["id"].to_numpy(), matrix(b["v"]), piv.value, norm, k)

    found = side.groupBy("i", "j").cogroup(ask.groupBy("i", "j")).applyInPandas(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id with several vectors: its best
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def audit_recall(index: DataFrame, found: DataFrame, queries: DataFrame, k: int, sample: int = 256, key: str = "vec_id",
                 vector: str = "embedding") -> float:
    """Recall of ``found`` for at most ``sample`` queries (smallest id hashes), against brute force over all rows."""
    some = valid_vectors(queries, key, vector).orderBy(F.xxhash64("id"), "id").limit(sample).select(
        F.col("id").alias("query_id"), F.col("v").alias("q"))
    pairs = valid_vectors(index, key, vector).join(F.broadcast(some), F.col("id") != F.col("query_id"))
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    exact = pairs.select("query_id", "id", dot.alias("s")).withColumn("r", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("s"), "id"))).where(F.col("r") <= k)
    hit = exact.join(found.select("query_id", F.col("vec_id").alias("id"), F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return float(hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 1.0)
