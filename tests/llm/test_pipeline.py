"""The pipeline, each stage against a plain version of its operator on its own input."""

import re
from collections import Counter

import sentencepiece

import corpus_pipeline
from promoscope.llm import piece_codec
from promoscope.llm.line_quality import LineRules, judge
from promoscope.session import scratch_path
from test_line_runs import plain as plain_lines
from test_pivotal_mix import plain_targets
from test_probminhash import plain_classes

SMOKE_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_are_those_of_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near duplicates", "mixing", "sentencepiece"]


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    columns, inputs = docs.columns, [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch_path(spark, f"stage-{number}")
        stage(spark, inputs[-1], SMOKE_DIR).write.parquet(path)
        inputs.append(spark.read.parquet(path))
        if number < 4:
            assert inputs[-1].columns == columns and inputs[-1].schema.simpleString() == docs.schema.simpleString()
    raw, good, lines, once, mixed, ids = ([r.asDict() for r in d.collect()] for d in inputs)

    verdicts = {r["doc_id"]: judge(r["text"], LineRules()) for r in raw}
    assert {r["doc_id"]: r["text"] for r in good} == {i: v[-1] for i, v in verdicts.items() if v[6]}

    want = {i: kept for i, _, _, kept in plain_lines([(r["doc_id"], r["text"]) for r in good], 10)}
    assert {r["doc_id"]: r["text"] for r in lines} == want

    classes = plain_classes([(r["doc_id"], r["text"]) for r in lines])
    assert sorted(r["doc_id"] for r in once) == sorted({c for _, c in classes})

    size = lambda r: len(WORD.findall(r["text"] or ""))
    sizes = Counter()
    for r in once:
        sizes[r["source"]] += size(r)
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += size(r)
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    for source, target in plain_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(size(r) for r in once if r["source"] == source)

    for rows in (good, lines, once, mixed):
        assert all(r["n_chars"] == len(r["text"]) for r in rows)

    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert Counter(r["doc_id"] for r in ids) == Counter(r["doc_id"] for r in mixed)
    assert all(r["ids"] == sp.encode(texts[r["doc_id"]]) for r in ids)


def test_pieces_are_aligned_with_the_text(spark):
    texts = ["plain words", "", None, "  two  spaces ", "é 😀\u0378 \U000e0001x", "tab\tand\nline"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in corpus_pipeline.pieces(spark, docs, SMOKE_DIR).collect()}
    c = piece_codec.Codec(corpus_pipeline.PIECES)
    for i, text in enumerate(texts):
        raw = (text or "").encode() + b"\0"
        spans = c.spans(text or "", got[i]["ids"]).tolist()
        assert got[i]["n_split"] == sum(any(raw[x] & 0xC0 == 0x80 for x in s) for s in spans)
    assert sum(r["n_split"] for r in got.values()) > 0


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMOKE_DIR)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 0
