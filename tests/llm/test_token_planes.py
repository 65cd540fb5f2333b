"""Token files against the library, exact round trips, and damaged files."""

import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from promoscope.llm import token_planes as P
from promoscope.llm.queries import QUERIES
from promoscope.session import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(WORD_BPE)
ODD = ["", " ", "It's we'll DON'T 'S o'", "a<|endoftext|>b x<|startoftext|> <|endo ftext|>|>", "é ́x Ạ́ á.", "x\x85y z w\x1cq\x00v",
       "ΑΣ ΑΣ. İI ſ K ŐSZ ÉTÉ", "日本語 テキスト🙂🙂👩‍👩‍👧 1234,5.", "." * 3000 + " " + "é" * 2000, "ﬁ Å Å ǰ J̌", "end.' a... b!?%% (c) [d]",
       "tab\tnew\nline\r\nff\x0cvt\x0b end", "under_score __x__ 3rd 4,000.50 x2y", "ﾊﾟ ㅎㅏㄴ क्षि नि. ك؟", " a　b c"]


def wanted(texts):
    return [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def got(words, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in words.encode(pa.array(texts, pa.string()))]


def test_odd_texts_have_the_librarys_ids():
    assert got(P.Words(WORD_BPE, True), ODD) == wanted(ODD)
    assert got(P.Words(WORD_BPE, False), ODD) == wanted(ODD)


def test_every_latin_letter_and_mark():
    chars = [chr(c) for c in range(1, 0x600) if chr(c) not in " \t\n\r\x0b\x0c"]
    texts = [f"a{c}" for c in chars] + [f"{c}." for c in chars] + [f"x{c}Y {c}{c}!" for c in chars]
    assert got(P.Words(WORD_BPE, True), texts) == wanted(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_random_texts_have_the_librarys_ids(texts):
    assert got(WORDS, texts) == wanted(texts)


WORDS = P.Words(WORD_BPE, True, remember=300)  # so small that words are forgotten all the time


def test_a_tokenizer_with_other_rules_is_used_whole():
    texts = [t for t in ODD if t]
    library = Tokenizer.from_file(BYTE_BPE)
    words = P.Words(BYTE_BPE, False)
    assert got(words, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert words.letters is None


@pytest.mark.parametrize("kind", sorted(P.PLANES))
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    planes = P.to_planes(ids, kind)
    assert planes.shape[0] == P.PLANES[kind]
    assert P.from_planes(planes, n, kind).tolist() == ids.tolist()
    bits = P.to_planes(np.array([1, 3, 1 << 31], "<u4"), "bit")
    assert [int(x[0]) for x in bits[[0, 1, 31]]] == [0b011, 0b010, 0b100]  # plane p has bit p of every id


@pytest.mark.parametrize("kind", sorted(P.PLANES))
def test_file_round_trip_and_random_access(kind):
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 5, 250, 1, 0, 1000, 99, 100)]
    sink = io.BytesIO()
    sink.close, raw = lambda: None, sink
    out = P.TokenFileWriter(raw, pa.int64(), kind, block_ids=100)
    for i, d in enumerate(documents):
        out.document(None if i == 3 else i, d.tobytes())
    size = out.close()
    assert size == len(raw.getvalue())
    file = P.TokenFile(raw, size)
    assert len(file.n_of) == 15 and file.n_of[:-1] == [100] * 14
    flat = np.concatenate(documents)
    at = 0
    for (doc_id, start, n, crc, ids), d, i in zip(file.documents(True), documents, range(99)):
        assert (doc_id, start, n, crc, ids) == (None if i == 3 else i, at, len(d), zlib.crc32(d.tobytes()), d.tobytes())
        assert file.ids(start, n).tolist() == d.tolist()
        at += n
    assert at == len(flat) and file.ids(95, 310).tolist() == flat[95:405].tolist()
    spoiled = bytearray(raw.getvalue())
    spoiled[len(P.MAGIC) + 9] ^= 255
    with pytest.raises(Exception):
        P.TokenFile(io.BytesIO(spoiled), size).block(0)
    with pytest.raises(ValueError, match="not a token file"):
        P.TokenFile(io.BytesIO(b"x" * 100), 100)


def brute(rows, end_id):
    """Rows (id, text) in order of (id with null last, text's place among equal ids is free)."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", sorted(P.PLANES))
def test_rows_against_brute_force(spark, kind):
    rows = [(i * 3 - 50, ODD[i % len(ODD)] + f" w{i}") for i in range(200)] + [(None, "last"), (None, None), (7001, "long " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as id", "1 as start", "'y' as row", "0 as tie")
    manifest = P.write_token_files(docs.repartition(5), WORD_BPE, scratch_path(spark, "planes"), end_id=9, planes=kind,
                                   block_ids=64, range_bytes=4000, file_ids=500)
    assert manifest.count() > 10
    out = P.read_token_files(spark, manifest, with_ids=True)
    found = sorted((tuple(r) for r in out.collect()), key=lambda r: r[1])
    nulls = [r for r in found if r[0] is None]
    assert len(nulls) == 2 and found[-2:] == nulls
    texts = dict(rows)
    last = [None, "last"] if nulls[0][2] == 1 else ["last", None]
    order = sorted(i for i, _ in rows if i is not None)
    want = brute([(i, texts[i]) for i in order] + [(None, t) for t in last], 9)
    assert [r[:4] for r in found] == want
    assert all(zlib.crc32(r[4]) == r[3] and len(r[4]) == 4 * r[2] for r in found)


def test_a_third_of_all_rows_under_one_id_is_split(spark):
    docs = spark.range(900).selectExpr("if(id % 3 = 0, 5, id) as doc_id", "concat('text number ', id % 300) as text")
    equal = spark.range(600).selectExpr("cast(5 as long) as doc_id", "'the same text' as text")
    for d in (docs, equal):
        manifest = P.write_token_files(d, WORD_BPE, scratch_path(spark, "planes"), range_bytes=500)
        n = [r.n_docs for r in manifest.collect()]
        assert sum(n) == d.count() and max(n) < 0.2 * sum(n)


def test_the_query_over_the_whole_table(spark):
    docs = sorted((tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()))
    out = QUERIES["op11_token_planes"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in out.collect()) == brute(docs, 1)
