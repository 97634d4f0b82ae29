"""Exact search against all products: ties, copies, hard bounds, odd rows."""

import math
import random

import numpy as np
import pytest

from groundwork.llm.vector_file import approximations, middles, packed, scan, top_k, unpacked


def plain(queries, vectors, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = {(i, tuple(v)) for i, v in vectors if i is not None and ok(v)}
    out = []
    for q, v in {(i, tuple(v)) for i, v in queries if i is not None and ok(v)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if len(w) == len(v) and (i, w) != (q, v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, c int")


def result(spark, queries, vectors, k, **more):
    return sorted(tuple(r) for r in top_k(frame(spark, queries), frame(spark, vectors), k, **more).collect())


@pytest.mark.parametrize("bits, block, shard", [(8, 16384, 8192), (3, 7, 20)])
def test_equals_all_products(spark, bits, block, shard):
    rng = random.Random(bits)
    rows = [(i, [float(rng.randrange(-30, 30)) for _ in range(6)]) for i in range(200)]
    rows += [(1000 + i, [3.0, 1.0, 0.0, -2.0, 9.0, 4.0]) for i in range(90)]  # many copies
    rows += [(2000 + i, [float(i % 3), 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # many ties
    rows += [(3000 + i, [0.5 * i, -0.0, 1e-3, 0.0, 7e4, 1.0]) for i in range(20)]
    queries = [r for r in rows if r[0] % 20 == 0] + [(5000, [0.0] * 6)]  # all rows tie with a zero vector
    got = result(spark, queries, rows + queries[-1:], 5, bits=bits, block=block, shard=shard)
    want = plain(queries, rows + queries[-1:], 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [5.0, 5.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, []), (8, [2.0, 2.0]), (20, [1.0, 1.0]), (40, [2.0]), (60, [9.0, 9.0, 9.0])]
    assert result(spark, rows, rows, 3) == plain(rows, rows, 3)
    assert result(spark, [], rows, 3) == [] and result(spark, rows, [], 3) == []


def test_bounds_hold_and_packing_is_exact():
    rng = np.random.default_rng(1)
    values = np.concatenate((rng.normal(size=(50, 9)), rng.integers(-9, 9, (50, 9)), np.zeros((2, 9)), np.full((2, 9), 1e300)))
    assert (unpacked(packed(values)) == values).all()
    for bits in (1, 4, 8):
        cells, low, step, distance = approximations(values, bits)
        off = np.abs(values - middles(cells, low, step))
        assert (off <= step[:, None] / 2 * (1 + 1e-6)).all()
        some = values[:100]
        cells, low, step, distance = approximations(some, bits)
        for of, row, lower, upper in scan(some, cells, low, step, distance, np.arange(len(some)), 200):
            exact = (some[of] * some[row]).sum(axis=1)
            assert (lower <= exact).all() and (exact <= upper).all()
