"""From raw documents to packed sequences: five stages, each a DataFrame of all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import broadcast_if, table
from tandem.llm.golay_simhash import near_duplicates
from tandem.llm.line_dedup import dedup_lines
from tandem.llm.packing import pack_documents
from tandem.llm.phrase_dedup import remove_repeats
from tandem.llm.queries import WORD_BPE
from tandem.llm.toxicity import fit, held_out, with_scores
from tandem.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.3
GONE = 1_000_000   # ids to drop that may be broadcast


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; ``n_chars`` follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``TOXIC``; the model learns from the labelled documents that aren't held out."""
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), usable=lambda i: ~held_out(i))
    return with_scores(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that enough others hold; those that lose all their lines go."""
    out = dedup_lines(docs.select(*COLUMNS))
    return _documents(out.where((F.col("n_dropped") == 0) | (F.length("text") > 0)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one that names it; documents without an id stay.

    The ids that go are far fewer than the texts, so behind a check of their number no text is shuffled.
    """
    named = near_duplicates(docs).where("doc_id is not null")
    gone = named.groupBy("doc_id").agg(F.max(F.expr("doc_id = component_id")).alias("names")).where("not names")
    gone = cut_lineage(gone.select(F.col("doc_id").alias("_gone")), "gone")
    return docs.select(*COLUMNS).join(broadcast_if(gone, GONE), F.col("doc_id") == F.col("_gone"), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring passages; those that lose all their words go."""
    out = remove_repeats(docs.select(*COLUMNS))
    return _documents(out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with the crc32 of their ids."""
    pieces = pack_documents(docs, WORD_BPE)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL has no subword model, XXH64, automata or tokenizer: tests/llm/test_pipeline.py compares with plain Python stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
