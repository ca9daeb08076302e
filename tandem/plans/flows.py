"""End-to-end flows, each one lazy Spark plan from raw files to results.

* :func:`prepare_corpus`  — utterance JSON → capped files → pairs → cleaned →
  dense ``sid`` → 90/5/5 split (written as Parquet/CSV/JSON Lines).
* :func:`train_and_score` — pairs → normalise → orient → length filter →
  vocabularies → lexicon (EM) → loss/perplexity → translation log → BLEU.
* :func:`bridge_dialects` — two dialect corpora sharing standard sentences →
  aligned dialect pairs → pivot translation (or composed lexicon) → BLEU.
* :func:`lr_lexicon`      — L-tokens of both sides, each by cohesion scores of its own → lexicon (EM).
* :func:`predict_table`   — a table of texts → L-tokens → best translations → text, written as CSV.
* :func:`batch_table`     — cohesion scores → L-tokens → frequency vocab →
  encoded, length-bucketed, padded batches with masks and positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import arrays as A
from tandem.functions import text as X
from tandem.operators import batches as B
from tandem.operators import clean as C
from tandem.operators import evaluate as V
from tandem.operators import lexicon as L
from tandem.operators import order as O
from tandem.operators import tokens as K
from tandem.operators import vocab as W
from tandem.session import cut_lineage
from tandem.sources import io


def prepare_corpus(spark: SparkSession, root: str, out: str | None = None, files_per_region: int | None = None,
                   **clean_kw) -> DataFrame:
    """Raw regional utterance files → cleaned, indexed, split pairs."""
    # the scan leaves out files beyond the cap of their folder; folders of one name are one region, capped together
    u = io.read_utterances(spark, root, cap=files_per_region)
    if files_per_region is not None:
        u = O.cap_per_group(u, ["region"], ["path"], n=files_per_region)
    u = io.index_utterances(u)
    pairs = u.select("sid", "region", F.col("standard_form").alias("standard"),
                     F.col("dialect_form").alias("dialect"))
    cleaned = C.clean_pairs(pairs, **clean_kw)
    split = O.split_ordered(cleaned.select("sid", "region", "standard", "dialect"),
                            partition_by=["region"])
    if out:
        io.write_pairs(split, f"{out}/parquet", "parquet", partition_by=("region", "split"))
        io.write_pairs(split, f"{out}/csv", "csv", partition_by=("region", "split"))
        io.write_pairs_json(split.select("sid", "region", "split", "standard", "dialect"), f"{out}/jsonl",
                            cols=("sid", "region", "split", "standard", "dialect"))
    return split


@dataclass
class ScoreReport:
    lexicon: DataFrame
    loss: DataFrame
    log: DataFrame
    bleu: DataFrame


def train_and_score(pairs: DataFrame, level: str = "word", dia2std: bool = True, max_len: int | None = None,
                    iters: int = 5, keep: str = X.NORMALIZE_KEEP, log_path: str | None = None) -> ScoreReport:
    """Lexical model trained on the train split, scored on the test split.

    ``pairs(sid, region, standard, dialect, split)``.
    """
    n = C.normalize_pairs(pairs, keep)
    o = C.filter_max_len(C.orient(n, dia2std), max_len, level)
    toks = o.select("region", "sid", "split", X.tokens("src", level).alias("src_tokens"),
                    X.tokens("trg", level).alias("trg_tokens"), "src", "trg")
    train = toks.filter(F.col("split") == "train")
    test = cut_lineage(toks.filter(F.col("split") == "test"), "test-pairs")
    lex = cut_lineage(L.learn_lexicon(train, iters=iters), "lexicon")
    loss = L.nll(test, lex)
    tr = L.translate(test, "src_tokens", lex, level=level)
    logged = test.join(tr, ["region", "sid"])
    if log_path:
        io.write_inference_log(logged, log_path, keys={"model": "lexicon", "level": level,
                                                       "direction": "dia2std" if dia2std else "std2dia"})
    scored = logged.select("region", "sid", X.words("trg").alias("ref_tokens"), X.words("inference").alias("hyp_tokens"))
    bleu = V.corpus_bleu_mean(V.sentence_bleu(scored, carry=("region",)), ["region"])
    return ScoreReport(lex, loss, logged, bleu)


def bridge_dialects(p1: DataFrame, p2: DataFrame, iters: int = 5, composed: bool = False) -> DataFrame:
    """Dialect 1 → dialect 2 through the standard language.

    ``p1``/``p2``: ``(sid, region, standard, dialect)`` of two regions. Returns
    ``(sid1, d1, d2, inference)``; with ``composed`` the two lexicons are
    composed first, otherwise the translation is chained through the middle.
    """
    pairs = L.pivot_pairs(p1, p2).filter(F.col("sid2").isNotNull()).withColumn("region", F.lit("bridge"))
    t1 = p1.select(F.lit("bridge").alias("region"), "sid", X.words("dialect").alias("src_tokens"),
                   X.words("standard").alias("trg_tokens"))
    t2 = p2.select(F.lit("bridge").alias("region"), "sid", X.words("standard").alias("src_tokens"),
                   X.words("dialect").alias("trg_tokens"))
    lex1, lex2 = L.learn_lexicon(t1, iters=iters), L.learn_lexicon(t2, iters=iters)
    src = pairs.select("region", F.col("sid1").alias("sid"), X.words("d1").alias("w"))
    if composed:
        out = L.translate(src, "w", L.compose_lexicons(lex1, lex2))
    else:
        out = L.pivot_translate(src, "w", lex1, lex2).drop("middle")
    return pairs.join(out.withColumnRenamed("sid", "sid1"), ["region", "sid1"]).select("sid1", "d1", "d2", "inference")


def batch_table(pairs: DataFrame, batch_size: int = 64, min_frequency: int = K.MIN_FREQUENCY,
                max_size: int | None = None) -> DataFrame:
    """Length-bucketed, padded id batches of the standard side.

    Returns ``(sid, batch, rank_in_batch, ids, mask, positions)``.
    """
    cleaned = C.clean_text_pairs(pairs)
    w = cleaned.select("sid", X.words("standard").alias("w"))
    scores = K.cohesion_scores(w, "w", min_frequency=min_frequency)
    lr = K.tokenize_lr(w, "w", scores).select("sid", X.lower_tokens("lr_tokens").alias("t"))
    vocab = W.vocab_by_freq(lr, "t", max_size=max_size)
    enc = W.encode(lr, "t", vocab, vocab_bound=None if max_size is None else max_size + 4)
    batched = B.bucket_batches(lr, F.size("t"), batch_size).join(enc, "sid")
    padded = B.pad_batch(batched, "ids")
    return padded.select("sid", "batch", "rank_in_batch", "ids", A.pad_mask("ids").alias("mask"),
                         A.position_ids("ids").alias("positions"))


def lr_tokens(df: DataFrame, text: str, scores: DataFrame, out: str = "lr_tokens") -> DataFrame:
    """``(sid, out)``: lower-case L-tokens of the cleaned ``text`` of every row, also of rows without words."""
    w = cut_lineage(df.select("sid", X.words(X.clean_text(F.coalesce(F.col(text), F.lit("")))).alias("w")), "words")
    return K.tokenize_lr(w, "w", scores).select("sid", X.lower_tokens("lr_tokens").alias(out))


def side_scores(df: DataFrame, text: str, min_frequency: int = K.MIN_FREQUENCY) -> DataFrame:
    """Cohesion scores of the cleaned words of one side, written."""
    return cut_lineage(K.cohesion_scores(df.select("sid", X.words(X.clean_text(text)).alias("w")), "w", min_frequency=min_frequency), "scores")


@dataclass
class LrLexicon:
    source_scores: DataFrame
    target_scores: DataFrame
    table: DataFrame


def lr_lexicon(pairs: DataFrame, src: str = "dialect", trg: str = "standard", iters: int = 5,
               min_frequency: int = K.MIN_FREQUENCY) -> LrLexicon:
    """The scores of both sides of ``pairs(sid, region, src, trg)``, and a lexicon learned on their L-tokens."""
    a, b = side_scores(pairs, src, min_frequency), side_scores(pairs, trg, min_frequency)
    toks = pairs.select("region", "sid").join(lr_tokens(pairs, src, a, "src_tokens"), "sid").join(lr_tokens(pairs, trg, b, "trg_tokens"), "sid")
    return LrLexicon(a, b, cut_lineage(L.learn_lexicon(toks, iters=iters), "lexicon"))


def predict_table(rows: DataFrame, scores: DataFrame, lexicon: DataFrame, text: str = "dialect", copy: bool = False,
                  out: str | None = None) -> DataFrame:
    """``(region, sid, text, inference)`` of every row of ``rows(sid, region, text)``, written to ``out`` as CSV if given.

    ``sid`` names a row. A text without words, or none, has an empty inference; a token that ``lexicon`` lacks
    becomes ``<unk>``, or itself with ``copy``.
    """
    toks = rows.select("region", "sid").join(lr_tokens(rows, text, scores), "sid")
    said = L.translate(toks, "lr_tokens", lexicon, copy=copy)
    done = rows.select("region", "sid", text).join(said.drop("region"), "sid").select("region", "sid", text, "inference")
    if out is None:
        return done
    io.write_pairs(done, out, "csv", partition_by=("region",))
    schema = done.select("sid", text, "inference", "region").schema
    return rows.sparkSession.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(
        out).select("region", "sid", text, F.coalesce("inference", F.lit("")).alias("inference"))
