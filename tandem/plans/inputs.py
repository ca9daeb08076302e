"""Inputs shared by the registered queries, derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.text import lower_tokens, words
from tandem.operators.clean import clean_pairs
from tandem.operators.em import Model
from tandem.operators.lexicon import learn
from tandem.operators.order import split_ordered
from tandem.operators.vocab import vocab_first_seen
from tandem.session import cut_lineage
from tandem.sources.testdata import line_pairs, sentence_pairs

# Fixed values for the Latin-script test corpus (it has no Hangul): the
# cleaner keeps Latin letters and rejects digits instead of Latin letters.
LATIN_KEEP = "a-zA-ZÀ-ÿ"
LATIN_NORMALIZE_KEEP = "a-zA-ZÀ-ÿ "
LATIN_REJECT = "[0-9]"
EM_ROUNDS = 5
BATCH_SIZE = 64
VOCAB_BOUND = 2_000_000   # vocabulary rows that may be broadcast
HISTORY_EPOCHS = 4
VALUE_ROWS = 50_000       # rows of one column-oriented JSON value, about
COMPOSE_MIN_P = 0.005   # entries that lexicons are pruned by before they are composed (the operator's own parameter)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return line_pairs(spark, sf)


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean_pairs(pairs(spark, sf), keep=LATIN_KEEP, reject=LATIN_REJECT)


def sentences(spark: SparkSession, sf: str, src: str = "dialect", trg: str = "standard") -> DataFrame:
    """All words of all pairs, sentence by sentence; ``sid`` is (line, sentence)."""
    p = sentence_pairs(spark, sf)
    return p.select("region", F.struct("sid", "sent").alias("sid"), words(src).alias("src_tokens"), words(trg).alias("trg_tokens"))


def model(spark: SparkSession, sf: str, src: str = "dialect", trg: str = "standard", spans: bool = False) -> Model:
    """Learned on every sentence of the corpus; ``spans``: for alignments too."""
    return learn(sentences(spark, sf, src, trg), iters=EM_ROUNDS, spans=spans)


def lexicon(spark: SparkSession, sf: str, src: str = "dialect", trg: str = "standard", least: float = 0.0) -> DataFrame:
    """Its table, of at least ``least``."""
    return model(spark, sf, src, trg).table(least)


def train_valid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sentences of the first nine tenths of the lines, and of the next twentieth."""
    split = split_ordered(pairs(spark, sf).select("sid")).select("sid", "split")
    s = cut_lineage(sentences(spark, sf).withColumn("line", F.col("sid.sid")).join(split.withColumnRenamed("sid", "line"), "line").drop("line"), "split")
    return s.where("split = 'train'").drop("split"), s.where("split = 'valid'").drop("split")


def side_vocab(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Every word of one side, numbered as first seen; its ranks are written, so it is not counted again where it is looked up."""
    return vocab_first_seen(pairs(spark, sf).select("sid", words(side).alias("w")), "w")


def lower_words(c):
    return lower_tokens(words(c))
