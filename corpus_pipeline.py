"""A cleaning pipeline over ``documents``: each stage's result is written and read by the next one.

Stages: quality rules, line dedup, MinHash near-dedup, mixing sources to target weights, and
SentencePiece encoding.  All but the last return the columns of ``documents``.

Defined cases, by stage: quality rules reject null, empty and short texts; line dedup counts documents by id
(rows with a null id as one) and empties a text of which ten documents or more have every line, exact copies
among them; of equal or near-equal texts, empty ones included, the document with the smallest id stays (null
ids last); mixing drops documents without a word, draws repeated rows one by one and takes a null source as
one of its own; encoding gives a null or empty text no id.  Texts are worked on whole, columns besides the id,
text, source and length are carried along whatever their names, and an empty table stays empty in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from promoscope.llm import line_quality, line_runs, piece_codec, pivotal_mix, probminhash
from promoscope.llm.common import table
from promoscope.session import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    return line_quality.clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents or more have."""
    return line_runs.deduped_documents(docs, min_docs=10)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return probminhash.one_of_each_class(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return pivotal_mix.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's pieces, which are aligned with the bytes of its text."""
    return piece_codec.encode_pieces(docs, PIECES, outputs=("ids", "ids_sha256", "decoded_sha256", "n_split"))


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_dedup),
    ("mixing", mixing), ("sentencepiece", pieces),
]

#: The mixing stage draws at random (by hash), which DuckDB cannot repeat.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.drop("n_split")  # the last stage's table has it; the query's columns are the others
