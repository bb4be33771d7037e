from __future__ import annotations

import math

import numpy as np

from loglake.llm.op9_topk_search import add_slices, at_least, kth_largest, top_k, _bitmaps

SCHEMA = "vec_id long, embedding array<float>, dim int"


def brute(rows, k=5, every=50):
    good = [
        (i, [math.floor(256 * x) for x in e]) for i, e, _ in rows
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e)
    ]
    good = [(i, e) for i, e in good if sum(x * x for x in e) < 1 << 62]
    out = []
    for at, (q, v) in enumerate(good):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, e)), i) for j, (i, e) in enumerate(good) if j != at and len(e) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def check(spark, rows, k=5):
    got = top_k(spark.createDataFrame(rows, SCHEMA), "vec_id % 50 = 0", k).collect()
    assert sorted(map(tuple, got)) == brute(rows, k)


def test_random_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist(), 0) for i in range(700)]
    rows += [(1000 + i, rows[50][1], 1) for i in range(30)] + [(i, rows[i][1], 2) for i in range(20, 120)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, -2.0], 1), (50, [0.0, 0.0], 1), (1, [3.5, 1.0], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [], 1),
        (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (None, [9.0, 9.0], 1), (7, [1.0], 1), (100, [2.0], 1),
        (150, [1.0, 2.0, 3.0], 1), (8, [1000.0, -1000.0], None), (9, [-0.001, 0.001], None),
    ]
    check(spark, rows)
    check(spark, rows, k=1)


def test_repeated_rows_are_rows(spark):
    """Equal rows, equal ids with other vectors, and a query whose own row is not among the best."""
    same = (50, [1.0, 0.5], 0)
    check(spark, [same, same, (1, [0.1, 0.1], 0)])
    rows = [same] * 9 + [(50, [-1.0, 2.0], 0)] * 2 + [(0, [0.01, 0.0], 0), (100, [0.0, 0.0], 0)] + [(i, [float(i), 1.0], 0) for i in range(1, 9)]
    check(spark, rows)
    check(spark, rows, k=1)


def test_large_components(spark):
    """Scores are exact up to the bound; vectors beyond it take no part."""
    rows = [(i, [(-1.0) ** i * 2.0**20 * i, 3.0, float(i)], 0) for i in range(30)]
    rows += [(50, [2.0**21, -(2.0**20), 1.5], 0), (100, [1e8, 1.0, 1.0], 0), (150, [1e30, 0.0, 0.0], 0), (31, [-1e300, 0.0, 0.0], 0)]
    check(spark, [(i, [float(np.float32(x)) for x in e if abs(x) < 1e38] or None, d) for i, e, d in rows])


def test_empty_table(spark):
    check(spark, [])


def test_bitmap_arithmetic():
    rng = np.random.default_rng(3)
    numbers, weights = rng.integers(0, 64, (10, 130)), rng.integers(0, 200, 10)
    planes = np.stack([_bitmaps((numbers >> b) & 1 == 1) for b in range(6)], axis=1)
    sums, want = add_slices(planes, weights), weights @ numbers
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little", count=130).astype(np.int64) for s in sums]
    assert (sum(b << i for i, b in enumerate(bits)) == want).all()
    every = _bitmaps(np.ones(130, bool))
    for k in (1, 5, 130):
        assert kth_largest(sums, every, k) == sorted(want)[-k]
    for bound in (-3, 0, 1, int(np.median(want)), int(want.max()), 1 << 40):
        hits = np.unpackbits(at_least(sums, every, bound).view(np.uint8), bitorder="little", count=130)
        assert (hits == (want >= bound)).all()
