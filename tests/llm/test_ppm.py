"""PPM scores against a plain trie, and the base score against a plain count."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from promoscope.llm.ppm import lm_scores
from promoscope.llm.queries import op2_lm_scoring
from promoscope.session import scratch_path

SMOKE_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = 256


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


class Trie:
    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for text in texts:
            for ctx, s in self.pairs(text):
                for k in range(order, -1, -1):  # a shorter context counts only what is new in the longer one
                    seen = self.counts[k, ctx[order - k:]]
                    seen[s] += 1
                    if seen[s] > 1:
                        break

    def pairs(self, text):
        symbols = [END] * self.order + list(text.encode()) + [END]
        return [(tuple(symbols[i - self.order:i]), symbols[i]) for i in range(self.order, len(symbols))]

    def probability(self, ctx, s):
        p, gone = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = self.counts.get((k, ctx[self.order - k:]))
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in gone}
            total = 2 * sum(left.values())
            if s in left:
                return p * (2 * left[s] - 1) / total
            if left:
                p *= len(left) / total
            gone |= set(seen)
        return p / (257 - len(gone))

    def score(self, text):
        return sum(math.log10(self.probability(*x)) for x in self.pairs(text))


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [*WORD.findall(low), None]


def plain(rows, order):
    train = [t or "" for i, t in rows if not held(i)]
    count = Counter(x for t in train for x in tokens(t))
    n, v = sum(count.values()), len(count)
    trie = Trie(train, order)
    out = {}
    for i, t in rows:
        own = tokens(t or "")
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)
        out[i, t] = (held(i), len(own), sum(x in count for x in own), n, base, trie.score(t or ""))
    return out


def check(rows, got, order):
    want = plain(rows, order)
    assert len(got) == len(rows)
    texts = dict(rows) if len({i for i, _ in rows}) == len(rows) else None
    for r in got:
        candidates = [w for (i, t), w in want.items() if i == r["doc_id"]] if texts is None else [want[r["doc_id"], texts[r["doc_id"]]]]
        assert any(tuple(r)[1:5] == w[:4] and tuple(r)[5:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9) for w in candidates)


def table(spark, rows):
    path = scratch_path(spark, "ppm-test")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_small_texts(spark, order):
    texts = ["", None, "a", "abracadabra", "ABRACADABRA cadabra", "é😀 ü", "the cat sat\non the mat", "zz\x00\xff", "the dog  sat",
             "the", " ", "mississippi mississippi", "qrstu vwxyz", "ÿ" * 20]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    check(rows, lm_scores(table(spark, rows), order=order, block_bytes=60).collect(), order)


def test_nothing_to_learn_from(spark):
    rows = [(i, "some text") for i in range(100) if held(i)]
    assert rows
    check(rows, lm_scores(table(spark, rows)).collect(), 4)


def test_probabilities_sum_to_one():
    trie = Trie(["abracadabra", "banana band"], 3)
    for text in ("abra", "xyz", "bana", ""):
        ctx = trie.pairs(text)[-1][0]
        assert sum(trie.probability(ctx, s) for s in range(257)) == pytest.approx(1, abs=1e-9)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = op2_lm_scoring(spark, SMOKE_DIR).collect()
    check(rows, got, 4)
    # on held-out documents the model is better than one byte in 257, and than the words alone
    size = sum(len((t or "").encode()) + 1 for i, t in rows if held(i))
    model, base = (sum(r[k] for r in got if r["held_out"]) for k in ("score", "base_score"))
    assert model > -size * math.log10(257) / 2
    print("held out, bits per byte:", -model / size / math.log10(2), "base:", -base / size / math.log10(2))
