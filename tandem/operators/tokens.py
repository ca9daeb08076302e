"""Cohesion scores and the L-tokeniser, computed over *distinct* words.

Words are counted once (partial + final aggregate) before anything is
exploded, so the work grows with the vocabulary, not with the corpus.
"""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators.lookup import looked_up
from tandem.operators.vocab import explode_tokens
from tandem.session import cut_lineage

MAX_LEFT_LENGTH = 10   # fixed value: longest prefix counted
MIN_FREQUENCY = 5      # fixed value: minimum prefix count for a score


def word_counts(df: DataFrame, tokens, key: str = "sid") -> DataFrame:
    return explode_tokens(df, tokens, key).groupBy(F.col("token").alias("word")).agg(
        F.count(F.lit(1)).alias("n"))


def prefix_counts(df: DataFrame, tokens, max_len: int = MAX_LEFT_LENGTH, key: str = "sid") -> DataFrame:
    """Every prefix of length 1..max_len of every word occurrence, counted."""
    return _prefixes(word_counts(df, tokens, key), 1, max_len)


def _prefixes(wc: DataFrame, low: int, high: int) -> DataFrame:
    ks = F.sequence(F.lit(low), F.least(F.length("word"), F.lit(high)))
    ex = wc.where(F.length("word") >= low).select("word", "n", F.explode(ks).alias("k"))
    return ex.groupBy(F.substring("word", F.lit(1), F.col("k")).alias("prefix")).agg(F.sum("n").alias("cnt"))


def cohesion_scores(df: DataFrame, tokens, min_frequency: int = MIN_FREQUENCY,
                    max_len: int = MAX_LEFT_LENGTH, key: str = "sid") -> DataFrame:
    """Forward cohesion ``(cnt(w) / cnt(w[0])) ** (1 / (len(w) - 1))``.

    For prefixes of length >= 2 seen at least ``min_frequency`` times. Words are
    counted and written once; the first-character table is bounded by the number of
    distinct characters, so it is broadcast.
    """
    wc = cut_lineage(word_counts(df, tokens, key), "word-counts")
    first = wc.where(F.length("word") >= 1).groupBy(F.substring("word", 1, 1).alias("c0")).agg(F.sum("n").alias("cnt0"))
    words = _prefixes(wc, 2, max_len).filter(F.col("cnt") >= min_frequency).withColumn("c0", F.substring("prefix", 1, 1))
    j = words.join(F.broadcast(first), "c0")
    return j.select(
        F.col("prefix").alias("word"),
        F.pow(F.col("cnt") / F.col("cnt0"), F.lit(1.0) / (F.length("prefix") - 1)).alias("cohesion"),
    )


def lr_splits(df: DataFrame, tokens, scores: DataFrame, key: str = "sid", max_len: int = MAX_LEFT_LENGTH) -> DataFrame:
    """For each distinct word longer than 2: the best left part, the rest, and how often the word occurs (``freq``).

    Candidates are prefixes of length 2..len; best = highest (score, length),
    an unscored prefix counts 0, so with no scored prefix the word stays whole.
    Prefixes over ``max_len`` (the limit of ``scores``) have no score and lose
    to the whole word, so only the shorter ones and the word itself are made:
    linear in the length of a word.
    """
    wc = word_counts(df, tokens, key).filter(F.length("word") > 2)
    cand = wc.select("word", "n", F.explode(F.array_union(
        F.sequence(F.lit(2), F.least(F.length("word"), F.lit(max_len))), F.array(F.length("word")))).alias("k")).withColumn(
        "prefix", F.substring("word", F.lit(1), F.col("k")))
    sc = scores.select(F.col("word").alias("prefix"), F.col("cohesion").alias("score"))
    j = cand.join(sc, "prefix", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = j.groupBy("word").agg(F.max(F.struct("score", "k")).alias("_b"), F.first("n").alias("n"))
    return best.select(
        "word",
        F.substring("word", F.lit(1), F.col("_b.k")).alias("l"),
        F.substring("word", F.col("_b.k") + 1, F.lit(1 << 30)).alias("r"),
        F.col("n").alias("freq"),
    )


def tokenize_lr(df: DataFrame, tokens, scores: DataFrame, key: str = "sid", out: str = "lr_tokens") -> DataFrame:
    """Cut every word into L + R (empty parts dropped), keeping word order.

    Returns ``(key, out)`` for every key of ``df``.
    """
    # a cut stands as "length of L:word", which holds for any word
    cuts = lr_splits(df, tokens, scores, key).select("word", F.concat_ws(":", F.length("l"), "word").alias("cut"), "freq")
    g = looked_up(df, tokens, cuts, "word", "cut", lambda t, p, row, c: pc.binary_join_element_wise("0:", t, ""), key, "_cuts")
    n = lambda c: F.substring_index(c, ":", 1)
    word = lambda c: F.substring(c, F.length(n(c)) + 2, F.lit(1 << 30))
    parts = lambda c: F.when(n(c) == "0", F.array(word(c))).otherwise(F.filter(
        F.array(F.substring(word(c), F.lit(1), n(c).cast("int")), F.substring(word(c), n(c).cast("int") + 1, F.lit(1 << 30))), lambda x: x != ""))
    return g.select(key, F.flatten(F.transform("_cuts", parts)).alias(out))
