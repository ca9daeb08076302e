"""Views over the driver tables that stand in for the reference's corpora.

* ``line_pairs``  (sid, region, standard, dialect, dialect2): one row per
  ``'\\n'``-line of ``documents.text``; ``dialect`` / ``dialect2`` come from two
  fixed literal rewrite chains, so both sides keep their word count.
* ``sentence_pairs`` (sid, region, sent, standard, dialect, dialect2): the same lines, cut
  behind ``.``, ``!`` and ``?``; ``sent`` counts the sentences of a line.
* ``conv_pairs``  (sid, standard, dialect): a user turn and the assistant turn
  right after it.
* ``epoch_log``   (run, epoch, train_loss, valid_loss, start_ts, end_ts): a
  training history derived from ``events`` (one row per event type and day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.text import SPACE_CLASS
from tandem.session import spread

# Line and turn stride of sids (more lines or turns are an error), and the two dialect rewrite chains.
LINE_STRIDE = TURN_STRIDE = 1 << 32
SENTENCE_END = f"(?U)([.!?])[{SPACE_CLASS}]+"
DIALECT_RULES = [("th", "d"), ("qu", "k"), ("sch", "sh")]
DIALECT2_RULES = [("ou", "u"), ("ie", "i"), ("ción", "sión")]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rewrite(c, rules):
    for a, b in rules:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    lines = docs.select(
        "doc_id", "lang", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line")
    )
    return lines.select(
        (F.col("doc_id") * LINE_STRIDE + F.col("pos")).alias("sid"),
        F.col("lang").alias("region"),
        F.col("line").alias("standard"),
        rewrite(F.col("line"), DIALECT_RULES).alias("dialect"),
        rewrite(F.col("line"), DIALECT2_RULES).alias("dialect2"),
    )


def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewrite chains touch no sentence end, so both sides have the same sentences."""
    cut = lambda c: F.split(F.regexp_replace(c, SENTENCE_END, "$1\n"), "\n", -1)
    sides = ["standard", "dialect", "dialect2"]
    rows = line_pairs(spark, sf_dir).select("sid", "region", F.posexplode(F.arrays_zip(*[cut(c).alias(c) for c in sides])).alias("sent", "x"))
    return rows.select("sid", "region", F.col("sent").cast("long").alias("sent"), *[F.col(f"x.{c}").alias(c) for c in sides])


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it. Turn order inside a
    conversation is a bucketed dense index, and the next turn is found by an
    equi-join on (conversation, position + 1): unique keys, no hot group."""
    from tandem.operators.order import dense_index

    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ix = dense_index(conv, ["turn"], partition_by=["conv_id"], name="k")
    nxt = ix.select("conv_id", (F.col("k") - 1).alias("k"), F.col("role").alias("next_role"),
                    F.col("text").alias("next_text"))
    j = ix.join(nxt, ["conv_id", "k"])
    return j.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        (F.col("conv_id") * TURN_STRIDE + F.when(F.col("turn") < TURN_STRIDE, F.col("turn")).otherwise(
            F.raise_error(F.lit("a conversation has too many turns")))).alias("sid"),
        F.col("text").alias("standard"),
        F.col("next_text").alias("dialect"),
    )


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    daily = ev.groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("day")).agg(
        F.round(F.avg("value") / 10, 6).alias("valid_loss"),
        F.round(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))) / 10, 6).alias("train_loss"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
    )
    first = daily.groupBy("run").agg(F.min("day").alias("_d0"))
    return daily.join(first, "run").select(
        "run",
        F.datediff("day", "_d0").cast("long").alias("epoch"),
        "train_loss", "valid_loss", "start_ts", "end_ts",
    )
