"""Ranked search against scoring every document for every item."""

import math
import random
import re

import pytest

from promoscope.llm import bag_search as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(items, docs, top):
    bags = [terms(t) for _, t in docs]
    N, L = sum(1 for b in bags if b), sum(map(len, bags))
    out = []
    for item, text in items:
        scores = [0] * len(docs)
        for t in set(terms(text)):
            df = sum(t in b for b in bags)
            w = math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1)))
            for d, b in enumerate(bags):
                if tf := b.count(t):
                    m = 50 + (50 * len(b) * N) // L
                    scores[d] += w * ((10**9 * tf) // (1000 * tf + 20 * m))
        best = sorted(((-s, docs[d][0] is None, docs[d][0] or 0, docs[d][0]) for d, s in enumerate(scores) if s > 0),
                      key=lambda r: r[:3])[:top]
        out += [(item, n + 1, r[3], -r[0]) for n, r in enumerate(best)]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def run(spark, items, docs, top=5, **options):
    it = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, number int")
    d = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in docs], "doc_id long, text string, id string, n int, m int, rank int")
    out = B.search(it, d.repartition(4), top=top, **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=key)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "naïve", "日本", "X-ray", "a_b", "it's", "10%"]
    made = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(made)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(12)]
    return items, docs


@pytest.mark.parametrize("top", [1, 5, 50])
def test_random_documents(spark, top):
    items, docs = corpus(120, top)
    docs += [(1000 + i, docs[0][1]) for i in range(60)]  # a large class of copies
    docs += [(2000 + i, f"{docs[1][1]} other{i}") for i in range(60)]  # equal bags, other texts
    assert run(spark, items, docs, top) == sorted(brute(items, docs, top), key=key)


def test_many_equal_scores_of_different_bags(spark):
    items = [(1, "apple"), (2, "apple pear")]
    docs = [(i, f"apple {'pear ' * (i % 2)}x{i} {'plum ' * (i % 3)}") for i in range(200, 0, -1)]
    assert run(spark, items, docs, 7) == sorted(brute(items, docs, 7), key=key)


def test_nulls_empties_repeats_and_long_texts(spark):
    items = [(1, None), (2, ""), (3, "..."), (None, "word"), (4, "word Word ÉTÉ é"), (4, "word"), (5, "rare"), (6, "absent")]
    docs = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "word"), (None, "word rare"), (4, "WORD\x00word-word été"),
            (5, "x " * 50_000 + "rare"), (6, "!!"), (7, "ÉTÉ É é")]
    assert run(spark, items, docs, 4) == sorted(brute(items, docs, 4), key=key)
    assert run(spark, items, docs, 4, block_bytes=100) == sorted(brute(items, docs, 4), key=key)


def test_empty_tables(spark):
    items, docs = corpus(10, 1)
    assert run(spark, [], docs) == run(spark, items, []) == run(spark, [], []) == []
    assert run(spark, items, [(1, None), (2, "--")]) == []


def test_terms_are_those_of_the_pattern():
    for c in range(0x250):
        text = f"aB{chr(c)}9 {chr(c)}"
        assert [t.decode() for t in B.terms_of(text.encode())] == terms(text)


def test_equal_hashes_of_different_bags_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(B, "class_hash", lambda: B.F.lit(7).cast("long"))
    items, docs = corpus(60, 9)
    assert run(spark, items, docs, 5) == sorted(brute(items, docs, 5), key=key)
