"""Token counts against the tokenizers library, whole texts and spliced ones."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from promoscope.llm.queries import BYTE_BPE, op3_token_counts
from promoscope.llm.token_counts import Chunk, count, encoder, splice

SMOKE_DIR = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENC = encoder(BYTE_BPE)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", " ", "a" * 5000, "ab " * 2000, " " * 3000 + "x", "x" + "\n " * 1500, "it's they'll we've " * 300,
    "日本語のテキスト" * 300, "é" * 700, "1234567890" * 300, "<|endoftext|>", "a<|endoftext|>b" * 50,
    "word " * 400 + "<|endoftext|>" + " tail" * 400, "!?.,;" * 500, "  　" * 200, "😀👍🏽" * 200,
    "x<|endof" + "text|>y" * 100, "\r\n" * 400, "a'" * 900,
]


@pytest.mark.parametrize("chunk,overlap", [(32, 4), (100, 16), (1000, 64), (1 << 15, 512)])
def test_odd_texts(chunk, overlap):
    assert [count(ENC, t, chunk, overlap) for t in ODD] == library(ODD)


@pytest.mark.parametrize("seed", range(8))
def test_random_texts(seed):
    rng = random.Random(seed)
    bits = ["the", " ", "  ", "\n", "é", "ß", "'s", "'", "42", "!", "日", "\t", "word", "<|", "😀", " ", "ll"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(20, 600))) for _ in range(60)]
    assert [count(ENC, t, 40, rng.choice([3, 8, 20])) for t in texts] == library(texts)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200), st.integers(8, 60), st.integers(2, 20))
def test_any_text(text, chunk, overlap):
    assert count(ENC, text, chunk, overlap) == library([text])[0]


def test_no_common_place_means_a_wider_overlap():
    text = "a" * 400
    left, right = Chunk(ENC, text, 0, 120), Chunk(ENC, text, 100, 220)
    assert splice(left, right) is None
    assert count(ENC, text, 100, 20) == library([text])[0]


def test_very_long_runs():
    texts = ["a" * 300_000, " " * 1_200_000 + "x", "y" + "\t " * 300_000, "word " * 60_000, "\n" * 300_000 + "z"]
    assert [count(ENC, t, 1 << 15, 512) for t in texts] == library(texts)


def test_query(spark):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op3_token_counts(spark, SMOKE_DIR).collect()}
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select("doc_id", "text").collect()
    texts = [r["text"] or "" for r in docs]
    want = {r["doc_id"]: (len(t.encode()), n, n > 1024) for r, t, n in zip(docs, texts, library(texts))}
    assert got == want
