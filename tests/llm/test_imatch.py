"""I-Match against a plain version; order, edited texts and likeness."""

import hashlib
import math
import random
import re
from collections import Counter

import xxhash

from promoscope.llm.imatch import fingerprints
from promoscope.llm.queries import op6_imatch
from promoscope.session import scratch_path

SMOKE_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SUBSETS, BAND, HASH = 256, (1.5, 9.0), (1 << 23) - 1


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed & (2**64 - 1))


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def long_hash(x, seed=42):
    return xx((x & (2**64 - 1)).to_bytes(8, "little"), seed)


def subset(term, draw, subsets):
    return signed(long_hash(term, xx((1000 + draw).to_bytes(4, "little")))) % subsets


def terms(text):
    return sorted({signed(xx(w.encode())) for w in WORD.findall(text)})


def chained(hashes):
    seed = 42
    for h in hashes:
        seed = long_hash(h, seed)
    return seed


def of_subset(s, hashes):
    low = (1 << 55) - 1
    return chained(sorted(s << 55 | h & low for h in hashes)) & HASH


def plain(rows, subsets=SUBSETS, draws=1):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0], signed(xx(r[1].encode()))))
    df = Counter(t for _, text in order for t in terms(text))
    least, most = (len(order) / math.exp(x) for x in reversed(BAND))
    known = {t for t, n in df.items() if least <= n <= most}

    def comps(text):
        out = {}
        for t in terms(text):
            if t in known:
                for d in range(draws):
                    out.setdefault(d * subsets + subset(t, d, subsets), []).append(t)
        return {s: of_subset(s, out[s]) for s in sorted(out)}, chained(terms(text))

    def likeness(a, b):
        if not a[0] and not b[0]:
            return float(a[1] == b[1])
        return sum(a[0].get(s) == h for s, h in b[0].items()) / len({*a[0], *b[0]})

    said = lambda c: ",".join(f"{s << 23 | h:X}" for s, h in c[0].items()) or f"all:{c[1] & (2**64 - 1):X}"
    out = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, other = comps(text), comps(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), said(own), said(other),
                    likeness(own, other), likeness(own, comps(after))))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select("doc_id", "text")
    found = got(op6_imatch(spark, SMOKE_DIR))
    assert found == plain([tuple(r) for r in docs.collect()])
    edited, after = (sum(r[k] for r in found) / len(found) for k in (5, 6))
    assert edited > 0.2 and edited > 4 * after


def test_odd_rows(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(300)] + ["é", "😀"]
    rows = [(3 * i - 50, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    rows += [(None, "no id"), (None, None), (1000, None), (1001, ""), (1002, " \n"), rows[5], rows[5], (1003, "x" * 5000),
             (2**60, "far " * 50)]
    path = scratch_path(spark, "imatch-test")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    assert got(fingerprints(df)) == plain(rows)
    assert got(fingerprints(df, subsets=9, draws=3)) == plain(rows, 9, 3)
    assert got(fingerprints(df, most_terms=0)) == plain(rows)  # a lexicon that does not go along with the tasks


def test_ranges_of_hot_ids_are_in_order(spark):
    rng = random.Random(3)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, " ".join(rng.choices("abcdefghij", k=12)) + f" {i % 170}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(fingerprints(df, range_bytes=1000)) == plain(rows)
    assert got(fingerprints(df, range_bytes=1000, most_ranges=3)) == plain(rows)


def test_every_term_of_the_band_counts(spark):
    """Short texts of random words: unrelated ones share no fingerprint, and half-edited ones keep likeness."""
    rng = random.Random(1)
    rows = [(i, " ".join(map(str, rng.sample(range(3000), 20)))) for i in range(3000)]
    found = got(fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert len({r[3] for r in found}) == len(rows) and not any(r[3].startswith("all:") for r in found)
    assert min(r[5] for r in found) > 0 and sum(r[5] for r in found) / len(found) > 0.25
    assert sum(r[6] for r in found) / len(found) < 0.02


def test_one_row_follows_itself(spark):
    path = scratch_path(spark, "imatch-one")
    spark.createDataFrame([(4, "a b c d")], "doc_id long, text string").write.parquet(path)
    assert got(fingerprints(spark.read.parquet(path))) == plain([(4, "a b c d")])


def test_only_dataframe_operations(spark):
    plan = op6_imatch(spark, SMOKE_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
