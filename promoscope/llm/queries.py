"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.llm import (
    bag_search, hard_negatives, imatch, line_quality, line_runs, piece_codec, pivotal_mix, ppm, probminhash,
    secret_scan, token_counts, token_planes, warc)
from promoscope.llm.common import table
from promoscope.llm.oracle import ORACLE  # noqa: F401 - registered with the queries
from promoscope.session import scratch_path

BYTE_BPE = token_counts.Vocabulary(
    public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    (("<|endoftext|>", 50256),), public_tokenizers.path("byte_bpe_50k.json"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc_pages(warc.read_warc(spark, manifest))


def warc_pages(read: DataFrame) -> DataFrame:
    """The columns of ``op1_warc``; a damaged record is an error, not a row of nulls."""
    damage = F.concat(F.lit("damaged archive "), "path", F.lit(": "), "error")
    return read.filter(F.when(F.col("error").isNull(), True).otherwise(
        F.raise_error(damage).cast("boolean"))).select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_page").cast("long").alias("refers_to"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"), BYTE_BPE).drop("base_spans")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_pieces(table(spark, sf_dir, "documents"), PIECES,
                                     outputs=("ids_sha256", "decoded_sha256", "n_split"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_runs.drop_frequent_lines(docs, min_docs=10)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf_dir, "documents"), with_text=False)


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_planes.write_token_files(
        table(spark, sf_dir, "documents"), WORD_BPE, scratch_path(spark, "token-planes"), end_id=1)
    return token_planes.read_token_files(spark, manifest).withColumnRenamed("id", "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", flipped), F.col("vec_id") % 100 == 0)


def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), top=50)


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_lm_scoring, op3_token_counts, op4_secret_scan, op5_sentencepiece, op6_imatch,
    op7_line_dedup, op8_pivotal_mix, op9_probminhash, op10_line_quality, op11_token_planes,
    op12_hard_negatives, op13_bag_search)}
