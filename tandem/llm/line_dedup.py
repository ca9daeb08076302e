"""Incremental, reversible line dedup: sharded cuckoo filters backed by an exact reference table.

A :class:`LineIndex` in a shared folder holds

* ``refs``: one row ``(h, doc_id)`` per document and line key, written once per
  insertion, with tombstones of deleted documents: the exact reference counts;
* ``hot``: the keys with at least ``min_docs`` references;
* ``filters``: cuckoo filters of the hot keys, by shard of the key (their number follows
  that of the first hot keys). An insertion adds the keys that get hot to their
  shards, a deletion of documents takes out those that no longer are; a shard that
  is full gets a further filter;
* ``log``: a row a change, written last. An index opened on the folder by another session
  goes on from there; a change that was cut short isn't in the log and is written over.

:meth:`LineIndex.clean` probes the filters map-side, so that only lines that may
be hot are shuffled, counts these exactly by the key itself, and drops them
everywhere but in the largest ``doc_id`` that holds them.

The text of a line's key: white space ``[\\x20\\x09-\\x0D]`` stripped at both ends,
A-Z in lower case; keys under ``min_chars`` code points are never dropped.

Defined results: a null or empty text is one empty line (null texts come back
empty); rows that repeat a ``doc_id`` count as one document and each lose the
same lines; rows with a null ``doc_id`` are no document for the counts and keep
all lines; further columns stay as they are. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import append_columns, broadcast_if, prepare, within
from tandem.llm.cuckoo import CuckooFilter
from tandem.session import cut_lineage, scratch_path

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS, SHARDS, SHARD_KEYS = 40, 5, 16, 100_000
#: Hot keys whose filters (about 2.4 bytes a key) go to all tasks; beyond, lines meet the hot keys in a sort-merge join.
PROBE_KEYS = 20_000_000
_FOLD = str.maketrans(UPPER, LOWER)
LOG = "version int, deletes boolean, min_chars int, min_docs int, shards int"


def line_key(line):
    """The key of a line, as a column."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def key_of(line: str) -> str:
    return line.strip(SPACES).translate(_FOLD)


class LineIndex:
    """``key``: the integer document id; ``path``: a shared folder with or without an index, a fresh one where none is given.

    An index that exists keeps the bounds it was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 shards: int = SHARDS, key: str = "doc_id", text: str = "text"):
        self.spark, self.path = spark, path or scratch_path(spark, "lines")
        self.min_chars, self.min_docs, self.shards, self.key, self.text = min_chars, min_docs, shards, key, text
        self.version, self.tombs = 0, []
        for r in self._log() if path else []:
            self.version, self.min_chars, self.min_docs, self.shards = r["version"], r["min_chars"], r["min_docs"], r["shards"]
            if r["deletes"]:
                self.tombs.append((r["version"], spark.read.parquet(f"{self.path}/tombs/v{r['version']}")))

    def _log(self) -> list:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy("version").collect()  # a row a change
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    # state ------------------------------------------------------------------------------------------------------

    def _lines(self, docs: DataFrame) -> DataFrame:
        """(doc_id, k, h) of all lines long enough; null ids are left out."""
        lines = docs.select(F.col(self.key).alias("doc_id"), F.explode(F.split(self.text, "\n", -1)).alias("k"))
        keys = lines.where("doc_id is not null").select("doc_id", line_key(F.col("k")).alias("k"))
        return keys.where(F.length("k") >= self.min_chars).select("doc_id", "k", F.xxhash64("k").alias("h"))

    def refs(self) -> DataFrame:
        """The live references (h, doc_id); a document may hold a line more than once."""
        parts = [self._live(i) for i in range(1, self.version + 1) if i not in {t for t, _ in self.tombs}]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _live(self, version: int) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/refs/v{version}")
        for at, gone in self.tombs:
            if at > version:
                df = df.join(gone, "doc_id", "left_anti")
        return df

    def _hot(self, refs: DataFrame) -> DataFrame:
        """Keys with enough references. Repeats in a document may count here: a superset, made exact in :meth:`clean`."""
        return refs.groupBy("h").count().where(F.col("count") >= self.min_docs).select("h")

    def hot(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/hot/v{self.version if version is None else version}")

    def filters(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/filters/v{self.version if version is None else version}")

    def _advance(self, deletes: bool = False) -> None:
        first = self.version == 1
        self._hot(self.refs()).write.mode("overwrite").parquet(f"{self.path}/hot/v{self.version}")
        now = self.hot()
        if first:
            self.shards = max(self.shards, -(-now.count() // SHARD_KEYS))
        shard = F.pmod(F.col("h"), F.lit(self.shards)).cast("int").alias("shard")
        if first:
            changes = now.select(shard, "h", F.lit(True).alias("up"))
            old = self.spark.createDataFrame([], "shard int, part int, blob binary")
        else:
            was = self.hot(self.version - 1)
            changes = now.join(was, "h", "left_anti").select(shard, "h", F.lit(True).alias("up")).union(
                was.join(now, "h", "left_anti").select(shard, "h", F.lit(False).alias("up")))
            old = self.filters(self.version - 1)

        def apply(key, filters: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            chain = [CuckooFilter.load(b) for b in filters.sort_values("part")["blob"]]
            up = change["up"].to_numpy(bool)
            h = change["h"].to_numpy(np.int64).view(np.uint64)
            for f in chain:
                mine = ~up & f.contains(h)
                f.remove(h[mine])
                h, up = h[~mine], up[~mine]
            h = h[up]
            if len(h):
                if not chain or chain[-1].size + len(h) > chain[-1].capacity:
                    chain.append(CuckooFilter(max(2 * len(h), chain[-1].capacity if chain else 0)))
                chain[-1].insert(h)
            return pd.DataFrame({"shard": [key[0]] * len(chain), "part": range(len(chain)), "blob": [f.dump() for f in chain]})

        new = old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, "shard int, part int, blob binary")
        new.write.mode("overwrite").parquet(f"{self.path}/filters/v{self.version}")
        done = [(self.version, deletes, self.min_chars, self.min_docs, self.shards)]
        self.spark.createDataFrame(done, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Takes the lines of new documents in."""
        prepare(self.spark)
        self.version += 1
        self._lines(docs).select("h", "doc_id").write.mode("overwrite").parquet(f"{self.path}/refs/v{self.version}")
        self._advance()
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes the references of documents back; ``doc_ids`` holds their ids."""
        self.version += 1
        path = f"{self.path}/tombs/v{self.version}"
        doc_ids.select(F.col(self.key).alias("doc_id")).where("doc_id is not null").distinct().write.mode("overwrite").parquet(path)
        self.tombs.append((self.version, self.spark.read.parquet(path)))
        self._advance(deletes=True)
        return self

    # use --------------------------------------------------------------------------------------------------------

    def maybe_hot(self, lines: DataFrame) -> DataFrame:
        """The lines whose key may be hot: all that are, and few others."""
        if not within(self.hot(), PROBE_KEYS):
            return lines.join(self.hot().hint("merge"), "h", "left_semi")
        blobs = [(r["shard"], r["blob"]) for r in self.filters().toLocalIterator()]
        sent, shards = self.spark.sparkContext.broadcast(blobs), self.shards
        loaded: dict = {}

        @F.pandas_udf("boolean")
        def probe(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if not loaded:
                for shard, blob in sent.value:
                    loaded.setdefault(shard, []).append(CuckooFilter.load(blob))
            for h in it:
                x = h.to_numpy(np.int64)
                out = np.zeros(len(x), bool)
                home = np.mod(x, shards)
                for shard, chain in loaded.items():
                    mine = np.flatnonzero(home == shard)
                    for f in chain:
                        out[mine] |= f.contains(x[mine].view(np.uint64))
                yield pd.Series(out)

        return lines.where(probe("h"))

    def hot_lines(self, docs: DataFrame) -> DataFrame:
        """``(k, keep, n_docs)``: keys held by at least ``min_docs`` of ``docs``, and the largest id that holds them."""
        hits = cut_lineage(self.maybe_hot(self._lines(docs)).select("doc_id", "k"), "hits")
        return self._exact(hits)

    def _exact(self, hits: DataFrame) -> DataFrame:
        return hits.groupBy("k").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keep")).where(
            F.col("n_docs") >= self.min_docs)

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` (all in the index) without the lines to drop, with ``n_lines`` and ``n_dropped``."""
        hits = cut_lineage(self.maybe_hot(self._lines(docs)).select("doc_id", "k"), "hits")
        exact = cut_lineage(self._exact(hits).select("k", "keep"), "hot-lines")
        drops = hits.join(broadcast_if(exact, 100_000), "k").where(F.col("doc_id") < F.col("keep")).groupBy(
            F.col("doc_id").alias("_id")).agg(F.collect_set("k").alias("_drop"))
        joined = docs.drop("_id", "_drop").join(drops, docs[self.key] == F.col("_id"), "left").drop("_id")
        names = joined.columns
        at, text, kind = names.index("_drop"), names.index(self.text), docs.schema[self.text].dataType

        def make():
            def run(b: pa.RecordBatch) -> list[pa.Array]:
                texts, n_lines, n_dropped = [], [], []
                for t, drop in zip(b.column(text).to_pylist(), b.column(at).to_pylist(), strict=True):
                    lines = (t or "").split("\n")
                    kept = lines
                    if drop:
                        gone = set(drop)
                        kept = [x for x in lines if key_of(x) not in gone]
                    texts.append(t or "" if kept is lines else "\n".join(kept))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                return [pa.array(texts, b.schema.field(text).type), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

            return run

        done = append_columns(joined, [T.StructField("_text", kind), T.StructField("n_lines", T.LongType()),
                                       T.StructField("n_dropped", T.LongType())], make)
        return done.select(*[F.col("_text").alias(c) if c == self.text else F.col(f"`{c}`") for c in docs.columns
                             if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One pass over a corpus: index all documents, then clean them."""
    return LineIndex(docs.sparkSession, min_chars=min_chars, min_docs=min_docs).insert(docs).clean(docs)
