"""Mixing: targets against a plain water-filling, rounding against its promises."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from promoscope.llm import pivotal_mix
from promoscope.llm.pivotal_mix import mix_sources, mixed_documents, round_block, targets
from promoscope.session import scratch_path

SMOKE_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(1, 2, 3), cap=3.0):
    """Share out by weight, cut at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in full]
        total = sum(w[s] for s in rest)
        got = {s: left * w[s] / total for s in rest}
        over = [s for s in rest if got[s] > cap * sizes[s]]
        if not over:
            return full | got
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 10 ** int(rng.integers(1, 7)), 9))} | {None: 5, "é": 7}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(rows, "source string, size long"), (1, 2, 3), 3.0).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_rounding_keeps_the_sum_and_the_expectation():
    rng = np.random.default_rng(1)
    p, w = rng.random(40), rng.integers(1, 50, 40).astype(float)
    total = np.zeros(40)
    for seed in range(4000):
        x = round_block(p, w, np.random.default_rng(seed))
        left = (x > 0) & (x < 1)
        assert left.sum() <= 1
        assert np.dot(x, w) == pytest.approx(np.dot(p, w))
        total += x
    assert np.abs(total / 4000 - p).max() < 0.05


def check(rows, got):
    """rows: id, source, text; got: id, size, source_size, target, copies, taken."""
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    by_id = {i: (s, len(WORD.findall(t or ""))) for i, s, t in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s, n = by_id[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * n and r["taken"] == n * r["copies"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], n)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_query(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    for block in (4, 4096):  # several levels, and one
        check(rows, mix_sources(docs, block=block).collect())


def test_odd_sources_and_reruns(spark):
    rows = [(i, ["a", None, "é", "empty", "big"][i % 5] if i % 7 else "big",
             None if i % 5 == 3 else "word " * (i % 13)) for i in range(500)]
    path = scratch_path(spark, "mix-test")
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    got = mix_sources(df, block=16).collect()
    check(rows, got)
    again = mix_sources(df.repartition(5), block=16).collect()
    assert sorted(got) == sorted(again)
    mixed = mixed_documents(df, block=16)
    assert mixed.columns == df.columns
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[r["doc_id"]] += 1
    assert dict(copies) == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


def test_rows_of_one_id_are_dealt_over_blocks(spark, monkeypatch):
    rows = [(7 if i % 3 == 0 else i, "a" if i % 2 else "b", "word " * (1 + i % 9)) for i in range(3000)]
    path = scratch_path(spark, "mix-hot")
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(path)
    keys = []
    tree = pivotal_mix.reduce_tree
    monkeypatch.setattr(pivotal_mix, "reduce_tree", lambda items, *a: keys.append(
        [r["key"] for r in items.select("key").collect()]) or tree(items, *a))
    got = mix_sources(spark.read.parquet(path), block=64).collect()
    assert len(got) == len(rows) and max(Counter(keys[0]).values()) == 1
    per = {r["source_size"]: r["target"] for r in got}
    for size, target in per.items():
        assert abs(sum(r["taken"] for r in got if r["source_size"] == size) - target) <= 9


def test_reruns_agree_however_the_rows_are_dealt_out(spark):
    """Half of all rows under one id, a sixth with none, and many rows that are equal in every column."""
    rows = [(7 if i % 2 else None if i % 3 == 0 else i, ["a", "b", None][i % 3], "word " * (1 + i % 9)) for i in range(900)]
    rows += [(8, "a", "five words of equal text")] * 300
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    runs = [sorted((tuple(r) for r in mix_sources(df.repartition(n), block=32).collect()), key=str) for n in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == len(rows)
    mixed = [sorted((tuple(r) for r in mixed_documents(df.repartition(n), block=32).collect()), key=str) for n in (2, 7)]
    assert mixed[0] == mixed[1] and len(mixed[0]) == sum(r[4] for r in runs[0])
    assert Counter(r[0] for r in mixed[0]) == Counter({i: n for i in {r[0] for r in rows} if (n := sum(r[4] for r in runs[0] if r[0] == i))})


def test_equal_rows_are_dealt_over_blocks(spark, monkeypatch):
    keys = []
    tree = pivotal_mix.reduce_tree
    monkeypatch.setattr(pivotal_mix, "reduce_tree", lambda items, *a: keys.append(
        [r["key"] for r in items.select("key").collect()]) or tree(items, *a))
    df = spark.createDataFrame([(8, "a", "equal text")] * 2000 + [(i, "b", "word") for i in range(1000)], "doc_id long, source string, text string")
    got = mix_sources(df, block=64).collect()
    assert len(got) == 3000 and len(set(keys[0])) == len(keys[0])
