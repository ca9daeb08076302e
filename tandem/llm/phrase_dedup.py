"""Substring dedup with repeated-phrase automata.

A window is ``window`` (35) consecutive words of one document; a word goes if
some window that covers it has a word sequence that also starts anywhere else.

1. *Phrases.* Of the runs of ``PHRASE`` words inside a window, the one with the
   smallest hash stands for the window. Equal windows have equal phrases, and
   only about one position in fourteen is a phrase, so phrases are counted
   over all documents instead of windows.
2. *Confirm.* In the documents that hold a phrase found in two places, the
   windows of such phrases are counted by hash. Those found twice or more are
   recurring passages. One document speaks for all that have the same text;
   texts that exist twice recur as a whole.
3. *Locate.* Documents are dealt out with the hashes of their confirmed
   windows. Each Arrow batch is a shard: its confirmed stretches become the
   keys of an Aho-Corasick automaton over words, which then streams the words
   of all documents of the shard; the spans that it finds are cut out. Only
   documents without any confirmed window skip the automata.

Every count and join is an equi-join or an aggregate on a hash; hot passages
are combined before the shuffle, and joins on them can be split. Hashes have 64
bits: with n distinct candidate windows, the share of windows that could be
taken for another one is n / 2**64.

Defined results: null and empty texts have no words and come back empty; rows
that repeat a ``doc_id`` are documents of their own, so their windows recur;
rows with a null ``doc_id`` take part too. Documents without a recurring
passage keep their text (the kept words are the same); others come back as
their kept words joined by single blanks. Further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import append_columns, broadcast_if, prepare
from tandem.llm.words import RUN_BASES, mix, run_hashes, sliding, text_buffer, word_hashes, word_spans
from tandem.session import cut_lineage

WINDOW, PHRASE = 35, 8
#: Row names (one long each) that may go to all tasks to keep texts out of a shuffle; beyond, texts are shuffled to them.
BROADCAST_ROWS = 2_000_000
_U = np.uint64


class _Batch:
    """Words, windows and phrases of a batch of texts."""

    def __init__(self, col: pa.Array, window: int):
        self.data, offsets = text_buffer(col)
        self.start, self.end, self.first = word_spans(self.data, offsets)
        self.words = word_hashes(self.data, self.start, self.end)
        self.doc = np.repeat(np.arange(len(col)), np.diff(self.first))
        self.window = window
        self.hash = run_hashes(self.words, window, RUN_BASES[1])
        n = len(self.hash)
        self.whole = self.doc[:n] == self.doc[window - 1 :] if n else np.zeros(0, bool)  # windows inside one document
        k = min(PHRASE, window)
        self.phrase = run_hashes(self.words, k, RUN_BASES[0])
        w = window - k + 1
        self.lead = sliding(self.phrase, w)  # the phrase that stands for the window which starts here
        lead = np.where(self.whole, self.lead, _U(0))
        pad = np.zeros(w - 1, _U)
        at = sliding(np.concatenate((pad, lead, pad)), w, np.maximum)
        self.picked = (at == self.phrase) & (at > 0) if n else np.zeros(len(self.phrase), bool)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _tag(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h + doc.astype(_U) * _U(0x9E3779B97F4A7C15))


def _once_each(x: _Batch, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places ``at`` with hashes ``h``: the first of each hash in each document, and whether it has more (2) or not (1)."""
    _, first, n = np.unique(_tag(h, x.doc[at]), return_index=True, return_counts=True)
    return first, np.minimum(n, 2).astype(np.int32)


def _phrases(docs: DataFrame, window: int) -> DataFrame:
    """(row, phrase, n): the phrases of each document, n = 2 for those that it has more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Batch(b.column(1), window)
            at = np.flatnonzero(x.picked)
            first, n = _once_each(x, at, x.phrase[at])
            at = at[first]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(x.doc[at])), _signed(x.phrase[at]), pa.array(n)], names=["row", "phrase", "n"])

    return docs.select("row", "text").mapInArrow(run, "row long, phrase long, n int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(row, h, n): windows whose phrase is among the repeated ones of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Batch(b.column(1), window)
            wanted = np.unique(b.column(2).flatten().to_numpy(zero_copy_only=False).view(_U))
            at = np.flatnonzero(x.whole & np.isin(x.lead[: len(x.whole)], wanted))
            first, n = _once_each(x, at, x.hash[at])
            at = at[first]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(x.doc[at])), _signed(x.hash[at]), pa.array(n)], names=["row", "h", "n"])

    return docs.select("row", "text", "phrases").mapInArrow(run, "row long, h long, n int")


def covered_words(x: _Batch, confirmed: np.ndarray, owner: np.ndarray, everything: np.ndarray) -> np.ndarray:
    """Which words of a batch lie in a recurring passage, found by one automaton over the batch.

    ``confirmed``: window hashes, each a recurring one of document ``owner``;
    ``everything``: documents that exist more than once.
    """
    gone = everything[x.doc] & (np.diff(x.first)[x.doc] >= x.window)
    n = len(x.hash)
    if not n or not len(confirmed):
        return gone
    # stretches: runs of confirmed windows; two documents never share one, as windows that cross are not whole
    hit = x.whole & np.isin(_tag(x.hash, x.doc[:n]), _tag(confirmed, owner)) & ~gone[:n]
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + x.window
    if not len(begin):
        return gone
    names, ids = np.unique(x.words, return_inverse=True)
    ids = ids.astype(np.int64) + 1
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for s, e in zip(begin.tolist(), stop.tolist(), strict=True):
        key = tuple(ids[s:e].tolist())
        automaton.add_word(key, e - s)
    automaton.make_automaton()
    cover = np.zeros(len(x.words) + 1, np.int64)
    for d in range(len(x.first) - 1):
        lo, hi = int(x.first[d]), int(x.first[d + 1])
        if hi - lo < x.window:
            continue
        for last, size in automaton.iter(tuple(ids[lo:hi].tolist())):
            cover[lo + last + 1 - size] += 1
            cover[lo + last + 1] -= 1
    return gone | (np.cumsum(cover[:-1]) > 0)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the words of recurring passages, with ``n_words`` and ``n_removed`` (both of the input)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    prepare(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "_row", "_all", "_h")
    whole = F.coalesce(F.col(text), F.lit(""))
    # names made of content, so that a lost task makes them again alike: a text has two hashes, a row a third one
    row = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("-")), whole)
    rows = docs.select(row.alias("row"), whole.alias("text"))
    copies = cut_lineage(docs.select(row.alias("row"), F.xxhash64(whole).alias("c"), F.xxhash64(F.lit(1), whole).alias("d")), "copies")
    texts = cut_lineage(copies.groupBy("c", "d").agg(F.min("row").alias("row"), (F.count("*") > 1).alias("twice")), "texts")
    speaking = broadcast_if(texts.select("row"), BROADCAST_ROWS)
    phrases = cut_lineage(_phrases(rows, window).join(speaking, "row", "left_semi"), "phrases")
    repeated = cut_lineage(phrases.groupBy("phrase").agg(F.sum("n").alias("n")).where("n > 1").select("phrase"), "repeated")
    wanted = cut_lineage(phrases.join(broadcast_if(repeated, BROADCAST_ROWS), "phrase").groupBy("row").agg(
        F.collect_list("phrase").alias("phrases")), "wanted")
    few = broadcast_if(wanted.select("row"), BROADCAST_ROWS)
    found = cut_lineage(_windows(rows.join(few, "row", "left_semi").join(wanted, "row"), window), "windows")
    confirmed = found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    passages = found.join(confirmed, "h").groupBy("row").agg(F.collect_list("h").alias("_h"))
    twice = copies.join(texts.where("twice").select("c", "d"), ["c", "d"], "left_semi").select("row", F.lit(True).alias("_all")).distinct()
    marks = cut_lineage(passages.join(twice, "row", "full_outer").withColumn("_h", F.when(F.col("_all").isNull(), F.col("_h"))), "passages")
    joined = docs.withColumn("_row", row)
    marked = broadcast_if(marks.select(F.col("row").alias("_row")), BROADCAST_ROWS)
    plain = joined.join(marked, "_row", "left_anti").withColumns({"_all": F.lit(None).cast("boolean"), "_h": F.lit(None).cast("array<bigint>")})
    joined = joined.join(marked, "_row", "left_semi").join(marks.withColumnRenamed("row", "_row"), "_row").select(
        *plain.columns).union(plain).drop("_row")
    names = joined.columns
    t, a, h = names.index(text), names.index("_all"), names.index("_h")

    def make():
        def run(b: pa.RecordBatch) -> list[pa.Array]:
            col = b.column(t)
            x = _Batch(col, window)
            lists = b.column(h)
            sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            everything = np.array([bool(v) for v in b.column(a).to_pylist()], bool)
            gone = covered_words(x, flat, np.repeat(np.arange(len(sizes)), sizes), everything)
            lost = np.bincount(x.doc[gone], minlength=len(col))
            out = []
            for d, value in enumerate(col.to_pylist()):
                if not lost[d]:
                    out.append(value or "")
                    continue
                lo, hi = x.first[d], x.first[d + 1]
                keep = np.flatnonzero(~gone[lo:hi]) + lo
                out.append(" ".join([x.data[s:e].tobytes().decode() for s, e in zip(x.start[keep], x.end[keep], strict=True)]))
            return [pa.array(out, col.type), pa.array(np.diff(x.first)), pa.array(lost)]

        return run

    done = append_columns(joined, [T.StructField("_text", docs.schema[text].dataType), T.StructField("n_words", T.LongType()),
                                   T.StructField("n_removed", T.LongType())], make)
    return done.select(*[F.col("_text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], "n_words", "n_removed")
