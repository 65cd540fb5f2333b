"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import public_tokenizers
import pytest
from pyspark.sql import types as T

from promoscope.llm import (
    bag_search, imatch, line_quality, line_runs, piece_codec, pivotal_mix, ppm, probminhash, secret_scan,
    token_counts, token_planes, warc)
from promoscope.session import scratch_path

BYTE_BPE = token_counts.Vocabulary(
    public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    (("<|endoftext|>", 50256),), public_tokenizers.path("byte_bpe_50k.json"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def token_files(docs):
    spark = docs.sparkSession
    return token_planes.read_token_files(spark, token_planes.write_token_files(docs, WORD_BPE, scratch_path(spark, "ids-test")))


def round_trip(pages):
    spark = pages.sparkSession
    pages = pages.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")
    return warc.read_warc(spark, warc.write_warc(pages, scratch_path(spark, "warc-test"), url_col=None))


OPERATORS = {
    "warc": round_trip,
    "ppm": ppm.lm_scores,
    "token_counts": lambda d: token_counts.token_counts(d, BYTE_BPE, 1024),
    "secret_scan": lambda d: secret_scan.secret_scan(d, BYTE_BPE),
    "piece_codec": lambda d: piece_codec.encode_pieces(d, PIECES),
    "imatch": imatch.fingerprints,
    "line_runs": line_runs.drop_frequent_lines,
    "deduped": lambda d: line_runs.deduped_documents(d),
    "pivotal_mix": pivotal_mix.mix_sources,
    "probminhash": probminhash.near_duplicates,
    "line_quality": line_quality.line_quality,
    "token_planes": token_files,
}

# names that the operators use themselves, as extra columns
CLASHING = ["id", "size", "rid", "n", "p", "key", "value", "score", "bands", "node", "x1", "class_id", "n_tokens",
            "n_chars", "kept", "row", "__id", "__text", "text_hash", "batch", "block", "level", "fingerprint", "at"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASHING if c != "n_chars"),
    T.StructField("n_chars", T.LongType())])


def rows():
    long = " ".join(f"word{i % 997}" for i in range(60_000)) + "\n" + "x" * 200_000 + "\n" * 3000
    texts = [
        (1, None, None), (2, "", "a"), (3, " \n\t\r ", "a"), (4, "one", "b"), (5, long, "b"),
        (6, "same text of five words or more here.", "a"), (7, "same text of five words or more here.", "a"),
        (7, "same text of five words or more here.", "a"), (8, "żółć € 😀   \x00 end", None),
        (None, "no id", "a"), (None, None, None), (9, "a\r\nb\r\na", "c"),
    ]
    return [(i, t, s, *(["clash"] * (len(CLASHING) - 1)), 0) for i, t, s in texts]


@pytest.fixture(scope="module")
def odd(spark):
    path = scratch_path(spark, "odd")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, name):
    assert OPERATORS[name](odd).count() == len(rows())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_all_null(spark, name):
    bare = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, source string, n_chars long")
    assert OPERATORS[name](bare).count() == 3


def test_filtering_operators_on_odd_rows(odd):
    assert line_quality.clean_documents(odd).count() <= len(rows())
    kept = probminhash.one_of_each_class(odd).select("doc_id", "text").collect()
    assert sum(r["text"] is not None and r["text"].startswith("same text") for r in kept) == 1
    assert probminhash.one_of_each_class(odd).columns == odd.columns
    assert pivotal_mix.mixed_documents(odd).columns == odd.columns
    assert line_runs.deduped_documents(odd).columns == odd.columns


def test_filtering_operators_on_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (line_quality.clean_documents, probminhash.one_of_each_class, pivotal_mix.mixed_documents,
              line_runs.deduped_documents):
        assert f(empty).count() == 0


EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_values_of_nulls_empties_and_repeated_rows(odd):
    def by_id(df, *columns):
        out = {}
        for r in df.collect():
            out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
        return out

    counts = by_id(token_counts.token_counts(odd, BYTE_BPE, 1024), "n_bytes", "n_tokens", "over_limit")
    assert counts[1] == counts[2] == [(0, 0, False)] and counts[4] == [(3, 1, False)] and counts[5][0][2]
    assert len(counts[7]) == 2 and len(set(counts[6] + counts[7])) == 1 and sorted(counts[None])[0] == (0, 0, False)
    spans = by_id(secret_scan.secret_scan(odd, BYTE_BPE), "n_assign", "n_access", "n_hex", "n_random", "spans", "base_sha256")
    assert spans[1] == spans[2] == spans[3] == spans[6] == [(0, 0, 0, 0, "", EMPTY_SHA)] and len(set(spans[7])) == 1
    pieces = by_id(piece_codec.encode_pieces(odd, PIECES, outputs=("ids_sha256", "decoded_sha256")), "n_tokens", "ids_sha256", "decoded_sha256")
    assert pieces[1] == pieces[2] == [(0, EMPTY_SHA, EMPTY_SHA)] and len(set(pieces[6] + pieces[7])) == 1
    files = by_id(token_files(odd).withColumnRenamed("id", "doc_id"), "n_tokens")
    assert files[1] == files[2] == files[3] == [(1,)] and files[4] == [(2,)] and len(files[None]) == 2


def test_search_over_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "same words"), (None, None), (2, "żółć 😀")], "item_id long, text string")
    got = sorted((r["item_id"], r["rank"], r["doc_id"]) for r in bag_search.search(items, odd).collect())
    assert got == [(1, 1, 6), (1, 2, 7), (1, 3, 7), (2, 1, 8)]
