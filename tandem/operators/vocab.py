"""Vocabularies, encoding and decoding as joins against a ``vocab`` table.

``vocab(token STRING, id INT, freq BIGINT)`` is a table. Its most frequent
tokens, at most ``HEAD_ROWS``, go to the workers, and sentences are looked up in them as they are
(:mod:`tandem.operators.lookup`). Only occurrences of the rarer tokens are exploded and joined, and their
ids come to the sentences, which are not exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.common import EOS_ID, SOS_ID, SPECIALS, UNK, UNK_ID, UNKNOWN_TEXT, as_col
from tandem.operators.lookup import HEAD_ROWS, flat_lists, joined_batches, looked_up
from tandem.operators.order import dense_index
from tandem.session import ship_package

SKETCH_LG_K = 14            # log2 of the registers of a sketch (16 KB at most)
SEEN_ROWS = 1 << 18         # sentences whose tokens are counted together before the exchange
SEEN_TOKENS = 1 << 21       # and tokens: either number is enough
HELD_TOKENS = 800_000       # distinct tokens that a worker holds between them
OUT_ROWS = 1 << 16          # rows of a batch that it gives
VOCAB_LIMIT = 33_000        # fixed value: cap of the frequency vocabulary, where the caller asks for one


def specials_table(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).alias("id"), F.lit(0).cast("long").alias("freq")) for t, i in SPECIALS])
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def explode_tokens(df: DataFrame, tokens, key: str = "sid", outer: bool = False) -> DataFrame:
    f = F.posexplode_outer if outer else F.posexplode
    return df.select(key, f(as_col(tokens)).alias("pos", "token"))


def token_freq(df: DataFrame, tokens, key: str = "sid") -> DataFrame:
    """Occurrences per token (partial + final hash aggregate)."""
    return explode_tokens(df, tokens, key).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def _least(tables: list[pa.Table]) -> pa.Table:
    """Each token once: its least (k, p), NULL first, and the sum of n."""
    t = pa.concat_tables(tables)
    coded = t["token"].combine_chunks().dictionary_encode("encode")
    code, k = coded.indices.to_numpy(), t["k"].combine_chunks()
    order = np.lexsort((t["p"].to_numpy(), pc.fill_null(k, 0).to_numpy(), k.is_valid().to_numpy(zero_copy_only=False)))[::-1]
    first = np.empty(len(coded.dictionary), np.int64)
    first[code[order]] = order      # the last one written is the least
    n = np.bincount(code, t["n"].to_numpy(), minlength=len(first)).astype(np.int64)
    return pa.table({"token": coded.dictionary, "k": k.take(pa.array(first)), "p": t["p"].take(pa.array(first)), "n": n})


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`_firsts` gives, each token once in as many rows as a worker may hold."""
    held, m = [], 0
    for b in _firsts(batches):
        held.append(pa.Table.from_batches([b]))
        m += b.num_rows
        if m > 2 * HELD_TOKENS:
            held = [_least(held)]
            m = held[0].num_rows
            if m > HELD_TOKENS:
                yield from held[0].to_batches(OUT_ROWS)
                held, m = [], 0
    if held:
        yield from _least(held).to_batches(OUT_ROWS)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, k, p, n) of rows (key, tokens): each token's least (key, position) and number in some thousand rows, NULL keys first."""
    for b in joined_batches(batches, SEEN_ROWS, SEEN_TOKENS):
        keys = b.column(0)
        sizes, flat = flat_lists(b.column(1))
        if not len(flat):
            continue
        rank = np.empty(b.num_rows, np.int64)
        least = pc.fill_null(keys, 0).to_numpy()
        turn = np.lexsort((least, keys.is_valid().to_numpy(zero_copy_only=False)))
        new = (np.diff(least[turn], prepend=least[turn[:1]]) != 0) | (np.diff(keys.is_valid().to_numpy(zero_copy_only=False)[turn].astype(np.int8), prepend=0) != 0)
        rank[turn] = np.cumsum(new)
        row = np.repeat(np.arange(b.num_rows), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        coded = flat.dictionary_encode("encode")
        code = coded.indices.to_numpy()
        if rank.max() == len(rank):     # a key a row: its words follow each other as they stand
            turned = np.argsort(rank)
            n, starts = sizes[turned], (np.cumsum(sizes) - sizes)[turned]
            order = (np.arange(len(flat)) + np.repeat(starts - (np.cumsum(n) - n), n))[::-1]
        else:
            order = np.lexsort((place, rank[row]))[::-1]
        first = np.empty(len(coded.dictionary), np.int64)
        first[code[order]] = order      # the last one written is the least
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary, keys.take(pa.array(row[first])), pa.array(place[first].astype(np.int32)), pa.array(np.bincount(code, minlength=len(first)))],
            names=["token", "k", "p", "n"])


def _seen(df: DataFrame, tokens, key: str) -> DataFrame:
    """(token, _f: its least (key, position), freq).

    Where keys are whole numbers, rows are counted some thousand at a time first: a least struct sorts its input, which would be all occurrences.
    """
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        return explode_tokens(df, tokens, key).groupBy("token").agg(
            F.min(F.struct(F.col(key).alias("k"), F.col("pos").alias("p"))).alias("_f"), F.count(F.lit(1)).alias("freq"))
    ship_package(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("k"), as_col(tokens).alias("_t"))
    kind = rows.schema["_t"].dataType.elementType
    fields = T.StructType([T.StructField("token", kind), T.StructField("k", T.LongType()), T.StructField("p", T.IntegerType()), T.StructField("n", T.LongType())])
    # dealt before they are counted: a worker gives few tokens twice. A least struct would sort the rows; least numbers are hashed, the
    # least position of each key first, so that none has two
    places = rows.mapInArrow(_gathered, fields).repartition("token").groupBy("token", "k").agg(F.min("p").alias("p"), F.sum("n").alias("n"))
    least = places.groupBy("token").agg(F.min("k").alias("k"), F.min_by("p", "k").alias("p"), F.min(F.when(F.col("k").isNull(), F.col("p"))).alias("_p0"), F.sum("n").alias("freq"))
    return least.select("token", F.struct(F.when(F.col("_p0").isNull(), F.col("k")).alias("k"), F.coalesce("_p0", "p").alias("p")).alias("_f"), "freq")


def vocab_first_seen(df: DataFrame, tokens, key: str = "sid", start: int = 4) -> DataFrame:
    """Ids from ``start`` in order of first appearance (key, pos); specials 0..3."""
    ix = dense_index(_seen(df, tokens, key), ["_f.k", "_f.p"], start=start, name="id", drop=["_f"])
    out = ix.select("token", F.col("id").cast("int").alias("id"), "freq")
    return specials_table(df.sparkSession).unionByName(out)


def shared_vocab(df: DataFrame, first, second, key: str = "sid", start: int = 4) -> DataFrame:
    """Vocabulary over both sides: all of ``first`` is seen before ``second``."""
    a = df.select(key, F.lit(0).alias("_part"), F.posexplode(as_col(first)).alias("pos", "token"))
    b = df.select(key, F.lit(1).alias("_part"), F.posexplode(as_col(second)).alias("pos", "token"))
    first_seen = a.unionByName(b).groupBy("token").agg(
        F.min(F.struct(F.col("_part").alias("q"), F.col(key).alias("k"), F.col("pos").alias("p"))).alias("_f"),
        F.count(F.lit(1)).alias("freq"),
    )
    ix = dense_index(first_seen, ["_f.q", "_f.k", "_f.p"], start=start, name="id", drop=["_f"])
    out = ix.select("token", F.col("id").cast("int").alias("id"), "freq")
    return specials_table(df.sparkSession).unionByName(out)


def vocab_by_freq(df: DataFrame, tokens, max_size: int | None = None, key: str = "sid",
                  min_freq: int = 1) -> DataFrame:
    """Ids 4.. by frequency desc, token asc; at most ``max_size`` real tokens
    (default: all)."""
    counts = token_freq(df, tokens, key).filter(F.col("freq") >= min_freq)
    if max_size is not None:
        # bounded top-k: per-partition heads merged in one small task
        top = counts.orderBy(F.desc("freq"), F.asc("token")).limit(max_size)
        from pyspark.sql import Window
        ranked = top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("freq"), F.asc("token"))) + 3))
    else:
        ranked = dense_index(counts, [-F.col("freq"), "token"], start=4, name="id")
    out = ranked.select("token", F.col("id").cast("int").alias("id"), "freq")
    return specials_table(df.sparkSession).unionByName(out)


def vocab_stats(vocab: DataFrame) -> DataFrame:
    """Vocabulary size including the specials."""
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def vocab_sketches(df: DataFrame, tokens, by: tuple[str, ...] = (), lg_k: int = SKETCH_LG_K) -> DataFrame:
    """``(by.., sketch)``: a HyperLogLog sketch of the distinct tokens of each group, to be stored and united later."""
    exploded = df.select(*by, F.explode(as_col(tokens)).alias("token"))
    return exploded.groupBy(*by).agg(F.hll_sketch_agg("token", lg_k).alias("sketch"))


def unite_sketches(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, without their tokens: regions, sides, or sketches of new data."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def vocab_preview(sketches: DataFrame) -> DataFrame:
    """``sketch`` replaced by ``vocab_size``, the estimated size including the specials.

    The standard error is about 0.83 / sqrt(2 ** lg_k) of the number of tokens: 0.65 % at 14.
    """
    size = (F.hll_sketch_estimate("sketch") + len(SPECIALS)).cast("long")
    return sketches.withColumn("vocab_size", size).drop("sketch")


def top_tokens(vocab: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent real tokens; ties by token."""
    real = vocab.filter(F.col("id") >= len(SPECIALS))
    return real.orderBy(F.desc("freq"), F.asc("token")).limit(k).select("token", "freq")


def _head(bound: int | None) -> int:
    """How many tokens of a vocabulary go to the workers; ``bound`` may lower it."""
    return HEAD_ROWS if bound is None else min(bound, HEAD_ROWS)


def encode(df: DataFrame, tokens, vocab: DataFrame, sos: bool = True, eos: bool = True,
           key: str = "sid", out: str = "ids", vocab_bound: int | None = None) -> DataFrame:
    """token → id (unknown → 0), optionally ``<sos>`` in front and ``<eos>`` behind.

    Returns ``(key, out)``; every key of ``df`` is kept, also with no tokens.
    """
    enc = looked_up(df, tokens, vocab, "token", "id", lambda t, p, row, c: pa.repeat(UNK_ID, len(t)), key, "_ids", _head(vocab_bound))
    parts = ([F.array(F.lit(SOS_ID))] if sos else []) + [F.col("_ids")] + ([F.array(F.lit(EOS_ID))] if eos else [])
    return enc.select(key, (F.concat(*parts) if len(parts) > 1 else F.col("_ids")).alias(out))


def decode(df: DataFrame, ids, vocab: DataFrame, key: str = "sid", out: str = "tokens",
           vocab_bound: int | None = None) -> DataFrame:
    """id → token; an id missing from the vocabulary → ``<unk>``."""
    return looked_up(df, ids, vocab, "id", "token", lambda t, p, row, c: pa.repeat(UNK, len(t)), key, out, _head(vocab_bound))


def encode_pairs(df: DataFrame, src_vocab: DataFrame, trg_vocab: DataFrame, src="src_tokens",
                 trg="trg_tokens", key: str = "sid", vocab_bound: int | None = None) -> DataFrame:
    """Both sides encoded with ``<sos>``/``<eos>``, joined back on the key."""
    a = encode(df, src, src_vocab, key=key, out="src_ids", vocab_bound=vocab_bound)
    b = encode(df, trg, trg_vocab, key=key, out="trg_ids", vocab_bound=vocab_bound)
    return a.join(b, key)


def _first_places(t: pa.Array, row: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """The first position of each ``t`` in the list of its row, -1 where it is not there or missing itself."""
    sizes, flat = flat_lists(lists)
    coded = pa.concat_arrays([t, flat.cast(t.type)]).dictionary_encode()
    code = pc.fill_null(coded.indices, -1).to_numpy()
    own, there = code[:len(t)], code[len(t):]
    wanted = np.zeros(len(coded.dictionary) + 1, bool)      # the last stands for what is missing
    wanted[own] = True
    wanted[-1] = False
    here = np.flatnonzero(wanted[there])
    at = np.repeat(np.arange(len(sizes)), sizes)[here]
    places, first = np.unique(at * np.int64(len(wanted)) + there[here], return_index=True)
    want = row * np.int64(len(wanted)) + own
    i = np.minimum(np.searchsorted(places, want), max(len(places) - 1, 0))
    found = (places[i] == want) & (own >= 0) if len(places) else np.zeros(len(t), bool)
    result = np.full(len(t), -1, np.int64)
    result[found] = (here - (np.cumsum(sizes) - sizes)[at])[first[i[found]]]
    return result


def encode_extended(df: DataFrame, tokens, vocab: DataFrame, vocab_size: int,
                    input_tokens=None, fixed_len: int | None = None, key: str = "sid",
                    out: str = "ids", vocab_bound: int | None = None, missing_id: int = EOS_ID, pad_id: int = 0) -> DataFrame:
    """Copy encoding with an extended vocabulary of size ``vocab_size`` + input length.

    Input side (``input_tokens`` None): an unknown token at position p → V + p.
    Output side: an unknown token → V + its first position in the input, else ``missing_id``.
    ``fixed_len`` pads with ``pad_id`` (sequences longer than it are an error in the
    reference; here they are left whole).
    """
    def oov(t: pa.Array, p: np.ndarray, row: np.ndarray, c: pa.Array | None) -> pa.Array:
        at = p if c is None else _first_places(t, row, c)
        return pa.array(np.where(at >= 0, at + vocab_size, missing_id).astype(np.int32))

    beside = None if input_tokens is None else as_col(input_tokens)
    enc = looked_up(df, tokens, vocab, "token", "id", oov, key, out, _head(vocab_bound), beside)
    if fixed_len is not None:
        from tandem.functions.arrays import pad_to
        enc = enc.withColumn(out, pad_to(out, fixed_len, pad=pad_id))
    return enc


def decode_extended(df: DataFrame, ids, vocab: DataFrame, vocab_size: int, input_tokens=None,
                    key: str = "sid", out: str = "text", vocab_bound: int | None = None, mask_id: int = 0) -> DataFrame:
    """As many leading ids as differ from ``mask_id``; id < V → token, else ``input[id - V]``
    (``<???>`` without input or past its end); joined by spaces."""
    a = as_col(ids)
    head = F.slice(a, F.lit(1), F.size(F.filter(a, lambda x: x != mask_id)))
    def word(t: pa.Array, p: np.ndarray, row: np.ndarray, c: pa.Array | None) -> pa.Array:
        known = pc.fill_null(pc.less(t, vocab_size), False).to_numpy(zero_copy_only=False)
        past = pa.repeat(UNKNOWN_TEXT, len(t))
        if c is not None:
            sizes, flat = flat_lists(c)
            place = pc.fill_null(t, -1).to_numpy().astype(np.int64) - vocab_size
            inside = (place >= 0) & (place < sizes[row])
            past = pc.fill_null(flat.take(pa.array((np.cumsum(sizes) - sizes)[row] + place, mask=~inside)), UNKNOWN_TEXT)
        return pc.if_else(pa.array(known), UNK, past)

    beside = None if input_tokens is None else as_col(input_tokens)
    # ids from V on are places of the input, whatever the vocabulary holds there
    known = vocab.where(F.col("id") < vocab_size)
    g = looked_up(df, head, known, "id", "token", word, key, "_w", _head(vocab_bound), beside)
    return g.select(key, F.array_join("_w", " ").alias(out))
