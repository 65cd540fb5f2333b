"""The threshold algorithm against scoring all pairs."""

import numpy as np
import pytest

from promoscope.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, row int, score int"


def brute(rows, n_pos=5, k=10, low=30, high=90):
    """Rows (id, vector or None, label); anchors have an id divisible by 10."""
    ok = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], lab) for i, v, lab in rows
          if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (aid, av, alab) in enumerate(ok):
        if aid is None or aid % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), last(i), i, lab) for b, (i, v, lab) in enumerate(ok) if b != a]
        scored.sort(key=lambda r: r[:2])
        for s, _, pid, _ in [r for r in scored if r[3] == alab][:n_pos]:
            fit = [r for r in scored if r[3] != alab and low * -s <= 100 * -r[0] <= high * -s][:k]
            out += [(aid, pid, n + 1, r[2], -s, -r[0]) for n, r in enumerate(fit)]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "a", 0, 1) for r in rows], SCHEMA)
    out = H.hard_negatives(df, df["vec_id"] % 10 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=key)


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims)
    return [(i, (centre + spread * rng.normal(size=dims)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("options", [dict(slab_rows=40, group_rows=3), {}])
def test_random_vectors(spark, options):
    rows = vectors(150, 8, 1)
    assert run(spark, rows, **options) == sorted(brute(rows), key=key)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rows = vectors(60, 4, 2)
    same = [0.5, 0.25, -0.5, 1.0]
    rows += [(i, same, i % 3) for i in range(100, 140)]  # a hot vector: all scores tie
    rows += [(10, same, 1), (10, same, 1), (None, same, 1), (None, same, 2)]  # repeated and null ids
    rows += [(200, None, 1), (210, [1.0, None, 0.0, 0.0], 1), (220, [float("nan")] * 4, 1), (230, [float("inf"), 0.0, 0.0, 0.0], 1),
             (240, same, None), (250, [0.0] * 4, 0), (260, [1.0], 1), (270, [], 2), (280, [-0.5, -0.25, 0.5, -1.0], 1)]
    assert run(spark, rows, slab_rows=25, group_rows=4) == sorted(brute(rows), key=key)


def test_no_rows_one_row_and_one_label(spark):
    assert run(spark, []) == []
    assert run(spark, [(10, [1.0, 2.0], 1)]) == []
    assert run(spark, [(i, [1.0, float(i)], 1) for i in range(30)]) == []
    assert run(spark, [(i, None, None) for i in range(3)]) == []


def test_components_beyond_the_limit_take_no_part(spark):
    rows = vectors(20, 3, 3)
    assert run(spark, rows + [(30, [1e30, 0.0, 0.0], 1)]) == sorted(brute(rows), key=key)


def test_large_components_are_scored_in_whole_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * 20_000).clip(-65_000, 65_000).astype(np.float32).tolist(), i % 2) for i in range(40)]
    rows += [(40, [65_000.0] * 6, 0), (41, [65_000.0] * 5 + [64_999.996], 0), (42, [65_000.0] * 5 + [40_000.0], 1)]
    assert run(spark, rows) == sorted(brute(rows), key=key)


def test_the_search_stops_early_where_it_can():
    rng = np.random.default_rng(0)
    n = 4096
    values = rng.integers(-20, 20, (n, 4))
    values[:50] += 400
    slab = H.Slab(np.arange(n), np.arange(n), np.zeros(n, int), values)
    seen = []
    score = slab.score
    slab.score = lambda which, anchor: seen.append(len(which)) or score(which, anchor)
    anchor = np.array([300, 200, -1, 100])
    (rows, scores), = slab.search(anchor, np.ones(n, bool), [(-10**9, 10**9)], 10)
    full = values @ anchor
    order = np.lexsort((np.arange(n), -full))[:10]
    assert rows.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
    assert sum(seen) < n / 4
