"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprint (64 bits): lower-cased words, 3-word shingles, XXH64; a bit is 1
where over half of the hashes have it. Fingerprints link within ``distance``
(3) bits.

The perfect binary Golay code (23, 12, 7) puts every 23-bit word within 3 bits
of exactly one codeword, so a codeword's 12-bit index is a key that tolerates
errors. A fingerprint is cut into three segments (22, 21 and 21 bits, padded
with zeros), and at most 3 differing bits fall on them in one of two ways:

* One segment has none. The other two have at most 3, so one of them has at
  most one. If two words differ by one bit, the codeword nearest to the one
  lies within 4 bits of the other; there are at most 6 such codewords, and
  they are looked up in a table made from the code. So one side gives
  (segment, nearest index of another segment) as its key, the other side
  (segment, each index within 4 bits): 6 ordered pairs, 33 or 34 bits a key.
* Each has one. Then one half of each segment has none: 8 choices of three
  halves, 32 bits a key, the same on both sides.

An equi-join on the keys misses no pair; distances are then verified on whole
fingerprints. Random pairs that share a key are some 4e-9 of all.

Only distinct fingerprints are joined: copies never multiply. A key that over
``SMALL`` distinct fingerprints share is dealt over blocks of ``BLOCK`` rows,
and each pair of blocks is compared in a group of its own that gives a
spanning forest of the links it finds, never all pairs.

Defined results: texts without words (null and empty ones too) have
fingerprint zero, linked like any other; every row has its own fingerprint and
component, rows that repeat a ``doc_id`` too; null ids get the component
of their fingerprint and never become its name unless no other id is there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import append_columns, broadcast_if, smallest_reachable
from tandem.session import cut_lineage

SHINGLE, DISTANCE, SEED = 3, 3, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
HALF = 11
#: Keys of few fingerprints that may go to all tasks (24 bytes each); beyond, a sort-merge join.
BROADCAST_KEYS = 1_000_000
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SMALL, BLOCK = 64, 2048
_U = np.uint64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    of = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), len(words) - shingle + 1
    pairs = list(zip(starts[:count].tolist(), ends[shingle - 1 :].tolist(), strict=True))
    for lo in range(0, count, 65536):
        h = np.array([of(line[s:e], SEED) for s, e in pairs[lo : lo + 65536]], _U)
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(_U)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp`` (the 64 bits as a signed long)."""
    at = docs.drop("fp").columns.index(text)

    def make():
        def run(b: pa.RecordBatch) -> list[pa.Array]:
            fps = np.array([fingerprint(t, shingle) for t in b.column(at).cast(pa.binary()).to_pylist()], _U)
            return [pa.array(fps.view(np.int64))]

        return run

    return append_columns(docs, [T.StructField("fp", T.LongType())], make)


@functools.cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 11-bit syndrome the error patterns that have it (the lightest first, then those of weight 4 where that
    has weight 3; padded to 6 by repeats) and how many; the index of a codeword by its upper 12 bits."""
    index = np.arange(4096, dtype=np.int64)
    words = np.zeros(4096, np.int64)
    for i in range(12):  # index times the generator polynomial
        words ^= np.where(index >> i & 1, GENERATOR << i, 0)
    one = np.array([_syndrome(1 << i) for i in range(23)])
    patterns: list[list[int]] = [[] for _ in range(2048)]
    spots = [(0, 0, -1)]  # (pattern, syndrome, last bit)
    for weight in range(5):
        for p, s, _ in spots:
            if weight < 4 or patterns[s] and bin(patterns[s][0]).count("1") == 3:
                patterns[s].append(p)
        spots = [(p | 1 << i, s ^ int(one[i]), i) for p, s, last in spots for i in range(last + 1, 23)] if weight < 4 else []
    count = np.array([len(p) for p in patterns])
    table = np.array([p + [p[0]] * (6 - len(p)) for p in patterns], np.int64)
    back = np.full(1 << 12, 0, np.int64)
    back[words >> 11] = index  # the upper 12 bits name a codeword
    return table, count, back


def _syndrome(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@functools.cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits."""
    return (np.array([_syndrome(i) for i in range(4096)]), np.array([_syndrome(i << 12) for i in range(2048)]))


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: the indices of the codewords that can be nearest to a word one bit away, the nearest first
    (n x 6, repeats behind), and how many there are."""
    table, count, back = _code()
    low, high = _syndromes()
    s = low[words & 4095] ^ high[words >> 12]
    return back[(words[:, None] ^ table[s]) >> 11], count[s]


def segments(fp: np.ndarray) -> list[np.ndarray]:
    fp = fp.view(_U)
    return [((fp >> _U(at)) & _U((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _keys(distinct: DataFrame) -> DataFrame:
    """(key, fp, own): a row for each key; ``own`` where it is the nearest index of both segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            segs = segments(fp)
            near = [near_indices(x) for x in segs]
            keys, rows, own = [], [], []
            for kind, (i, j) in enumerate(PAIRS):
                index, count = near[j]
                row, x = np.nonzero(np.arange(6)[None, :] < count[:, None])
                keys.append(kind << 40 | segs[i][row] << 12 | index[row, x])
                rows.append(row)
                own.append(x == 0)
            for choice in range(8):
                key = np.zeros(len(fp), np.int64)
                for i, x in enumerate(segs):
                    key = key << HALF | (x >> HALF if choice >> i & 1 else x & ((1 << HALF) - 1))
                keys.append((len(PAIRS) + choice) << 40 | key)
                rows.append(np.arange(len(fp)))
                own.append(np.ones(len(fp), bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(fp[np.concatenate(rows)]), pa.array(np.concatenate(own))],
                names=["key", "fp", "own"])

    return distinct.mapInArrow(run, "key long, fp long, own boolean")


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between and inside two sets of fingerprints that keep their components: at most one per fingerprint."""
    all_ = np.unique(np.concatenate((a, b)))
    group = np.arange(len(all_))
    out = []
    for i in range(len(all_)):
        hit = i + 1 + np.flatnonzero(np.bitwise_count(all_[i + 1 :] ^ all_[i]) <= distance)
        for g in np.unique(group[hit]):
            if g != group[i]:
                j = hit[group[hit] == g][0]
                out.append((int(all_[i]), int(all_[j])))
                group[group == g] = group[i]
    return out


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)``: verified links that join every two of the ``fp`` within ``distance`` (at most 3) into one component."""
    if distance > 3:
        raise ValueError("the segments guarantee up to 3 differing bits")
    keys = cut_lineage(_keys(distinct), "golay-keys")
    # a key only matters where one fingerprint has it as its own and another has it too
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 and owned")
    sizes = cut_lineage(sizes.select("key", "n"), "golay-sizes")
    few = cut_lineage(keys.join(broadcast_if(sizes, BROADCAST_KEYS), "key").where(F.col("n") <= SMALL).select("key", "fp", "own"), "golay-few")
    own = few.where("own").select("key", F.col("fp").alias("a"))
    pairs = own.join(few.select("key", F.col("fp").alias("b")), "key").where(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # hot keys: every block meets every other one of its key
    many = sizes.where(F.col("n") > SMALL).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    hot = keys.join(broadcast_if(many, BROADCAST_KEYS), "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    meet = hot.select("key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi"))).alias("m")).alias("m"), "i")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(_U)
        links = np.array(_forest(fp, fp[:0], distance), _U).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return found.union(meet.groupBy("key", "m.lo", "m.hi").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``: the class of each, named by its smallest id."""
    rows = with_fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), shingle=shingle)
    fps = cut_lineage(rows.select("doc_id", "fp"), "fingerprints")
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = smallest_reachable(fingerprint_links(distinct.select("fp"), distance), name="simhash")
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
