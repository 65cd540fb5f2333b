"""SentencePiece: ids and decoding by the library, normalisation and spans against the library's own."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from promoscope.llm.piece_codec import Normalizer, codec
from promoscope.llm.queries import PIECES, op5_sentencepiece

SMOKE_DIR = "/root/testdata/sf0.001"
CODEC = codec(PIECES)
ODD = ["", " ", "a", "  two  spaces ", "é ß 日本語", "😀👍🏽", "tab\tnew\nline", "▁meta ▁ mark", "ﬁ ﬂ ①②③ ㎞ ＡＢＣ",
       "é ä", " no break　wide", "x" * 500, "\x07\x7f control", "한국어 텍스트", "½ ™ …", "a​b﻿c"]


def test_spans_tile_the_text():
    for text in ODD:
        ids = CODEC.encode([text])[0]
        spans = CODEC.spans(text, ids)
        raw = text.encode()
        assert len(spans) == len(ids)
        if len(ids):
            assert spans[0][0] == 0 and spans[-1][1] == len(raw) and (spans[1:, 0] == spans[:-1, 1]).all()
        for (a, b), i in zip(spans, ids):
            piece = CODEC.sp.id_to_piece(i)
            if not CODEC.sp.is_byte(i):
                assert raw[a:b].decode().replace(" ", "▁") in (piece, piece.removeprefix("▁"))
            else:
                assert raw[a:b] == bytes([int(piece[3:-1], 16)])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf", "identity"])
@pytest.mark.parametrize("dummy", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("escape", [False, True])
def test_normalisation_matches_the_library(rule, dummy, squeeze, escape):
    own = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=squeeze, escape_whitespaces=escape)
    mine = Normalizer(own.serialized_model_proto())
    rng = random.Random(3)
    alphabet = list(" 　\t\n") + ["  ", "ﬁ", "①", "Ａ", "é", "é", "日", "😀", "a", "Z", "ß", "½", "​", "㎞", "İ"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    for text in texts:
        want, places = own.normalize(text, with_offsets=True)
        got, at = mine(text.encode())
        assert got.decode() == want, (text, got.decode(), want)
        # the library gives character offsets per character of the result
        starts = np.flatnonzero([b & 0xC0 != 0x80 for b in got])
        chars = [len(text.encode()[:int(at[s])].decode("utf-8", "ignore")) for s in starts]
        assert chars == list(places)[:len(chars)], (text, chars, places)


def test_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()}
    got = op5_sentencepiece(spark, SMOKE_DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = sp.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
