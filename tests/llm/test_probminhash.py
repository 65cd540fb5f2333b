"""ProbMinHash: the estimate, and classes against all pairs compared."""

import random
import re

import numpy as np
import pyarrow as pa

from promoscope.llm.components import components
from promoscope.llm.probminhash import (
    band_hashes, both_bands, near_duplicates, one_of_each_class, shingles, signatures)
from promoscope.session import scratch_path

SMOKE_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(rows):
    """Smallest id of each row's class, all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, best.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def classes(df, **options):
    return sorted((tuple(r) for r in near_duplicates(df, **options).select("doc_id", "class_id").collect()), key=str)


def test_shingles_are_those_of_the_words():
    rng = random.Random(1)
    texts = ["", " ", "a", "a b c d", "a b c d e", "a b c d e a b c d e", "é 😀\tx\ny  z w", " lead and trail "]
    texts += ["".join(rng.choice(["ab", "a", "é", " ", "\n", "  "]) for _ in range(60)) for _ in range(40)]
    doc, h, weight = shingles(pa.array(texts), 5)
    ids = {}
    for d, text in enumerate(texts):
        w = WORD.findall(text)
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        own = sorted(weight[doc == d].tolist())
        assert own == sorted(windows.count(x) for x in set(windows))
        for x in set(windows):
            ids.setdefault(x, set()).add(d)
    by_hash = {}
    for d, x in zip(doc.tolist(), h.tolist()):
        by_hash.setdefault(x, set()).add(d)
    assert sorted(map(sorted, by_hash.values())) == sorted(map(sorted, ids.values()))


def test_slots_agree_as_often_as_the_probability_jaccard():
    rng = np.random.default_rng(0)
    a = {int(x): int(w) for x, w in zip(rng.integers(1, 1 << 40, 60), rng.integers(1, 9, 60))}
    b = dict(list(a.items())[:45]) | {int(x): int(w) for x, w in zip(rng.integers(1, 1 << 40, 20), rng.integers(1, 9, 20))}
    for k in list(b)[:10]:
        b[k] += 3
    h = np.asarray([*a, *b], np.uint64)
    weight = np.asarray([*a.values(), *b.values()])
    doc = np.asarray([0] * len(a) + [1] * len(b))
    m = 4096
    got = signatures(2, doc, h, weight, m)
    want = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in a if x in b)
    assert abs((got[0] == got[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / m)
    # a text's signature is its own, whatever else is in the batch
    assert (signatures(1, doc[doc == 0], h[doc == 0], weight[doc == 0], m)[0] == got[0]).all()


def test_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select("doc_id", "text")
    assert classes(docs) == plain_classes([tuple(r) for r in docs.collect()])


def test_planted_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, " "), (n + 3, "a b"), (n + 4, "a  b"), (n + 5, "a b c"), (None, "")]
    rows += [rows[3], rows[3]]
    path = scratch_path(spark, "planted")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    want = plain_classes(rows)
    assert classes(df) == want
    kept = one_of_each_class(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want})


def test_one_row_of_a_class_whose_texts_share_an_id(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = [" ".join([*base[:k], "other", *base[k + 1:]]) for k in (0, 50, 199)]
    alone = [f"v{k} a b c d e" for k in range(2)]
    rows = [(7, near[0]), (7, near[1]), (7, near[1]), (9, near[2]), (7, alone[0]), (7, alone[1])]
    rows += [(None, t.replace("w", "z")) for t in near]
    path = scratch_path(spark, "one-id")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = [tuple(r) for r in one_of_each_class(spark.read.parquet(path)).collect()]
    assert sum(t in near[:2] for _, t in got) == 1 and sum(i is None for i, _ in got) == 1
    assert {t for _, t in got} >= set(alone) and len(got) == 4 and set(got) <= set(rows)


def test_copies_with_looped_passages_are_linked(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        loop = [f"loop{k}x{i}" for i in range(6)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + loop * 100))]
    path = scratch_path(spark, "looped")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    want = plain_classes(rows)
    assert want == sorted(((i, i - i % 2) for i, _ in rows), key=str)
    assert classes(spark.read.parquet(path)) == want


def test_bands_by_sets_and_by_weights():
    texts = ["a b c d e f g", "", "a b c d e f g " + "h i j k l " * 30, "a b c d e f g"]
    doc, h, weight = shingles(pa.array(texts), 5)
    hashes, own = both_bands(4, doc, h, weight, 16, 4)
    assert own.sum(axis=1)[[0, 1, 3]].tolist() == [16, 0, 16] and 16 <= own[2].sum() <= 32
    assert (hashes[0] == hashes[3]).all()
    assert len(set(hashes[2][own[2]].tolist())) == own[2].sum()
    whole = band_hashes(signatures(4, doc, h, weight, 64), 4)
    assert (whole[0] == hashes[0, :16]).all() and set(whole[2].tolist()) <= set(hashes[2].tolist())


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    root = list(range(200))
    for _ in range(200):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for u, v in links if u != v for x in (u, v)}
    assert got == {x: root[x] for x in linked if root[x] != x}
