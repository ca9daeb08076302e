"""Registered queries of this package (thin: operator, then digest columns) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import TOKENIZERS, table
from tandem.session import scratch_path

WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
RANKS = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_BPE)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.vector_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.phrase_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    # the digest is of the words alone: white space as single blanks, none at the ends
    words = F.btrim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.bpe_codec import decode, encode

    out = decode(encode(table(spark, sf_dir, "documents", "doc_id", "text"), RANKS).drop("text"), RANKS)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.toxicity import fit, held_out, with_scores

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), usable=lambda i: ~held_out(i))
    return with_scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                           (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in flat files of 16-bit ids (end id 50256), counted by the separator scan alone."""
    from tandem.llm.token_scan import scan, write_flat

    path = scratch_path(spark, "flat-tokens")
    placed = write_flat(table(spark, sf_dir, "documents", "doc_id", "text"), path, BYTE_BPE, 50256)
    return placed.hint("merge").join(scan(spark, path, 50256), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.permutation_index import search

    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.golay_simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.token_orc import read_tokens, with_crc32, write_tokens

    path = scratch_path(spark, "token-orc")
    write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path, BYTE_BPE, 2)
    return with_crc32(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.warc import read_archives, write_archives

    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.llm.vector_codes import books_sha256, learn, with_label_error

    coded, books = learn(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return with_label_error(coded).select("vec_id", code.alias("code"), "error", "label_error",
                                          F.lit(books_sha256(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_line_dedup, op3_vector_dedup, op4_substring_dedup, op5_byte_bpe, op6_toxicity, op7_token_counts,
    op8_permutation_index, op9_simhash, op10_token_orc, op11_warc, op12_spelling,
    op13_vector_codes)}
ORACLE: dict[str, str] = {}
