"""Hard negatives against scoring every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import hardneg


def slow(rows, near=5, low=80, high=100):
    usable = [(k, v, l) for k, v, l in rows if k is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(k, [math.floor(256 * x) for x in v], l) for k, v, l in usable]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (k, v, l) in enumerate(whole):
        if k % 100:
            continue
        scored = [(dot(v, w), j, m, label) for m, (j, w, label) in enumerate(whole) if m != n]
        for score, j, _, _ in sorted((s for s in scored if s[3] == l), key=lambda s: (-s[0], s[1]))[:near]:
            inside = [s for s in scored if s[3] != l and low * score <= 100 * s[0] <= high * score]
            out += [(k, j, r + 1, s[1], score, s[0]) for r, s in enumerate(sorted(inside, key=lambda s: (-s[0], s[1]))[:near])]
    return sorted(out)


def drawn(n, width, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for k in range(n):
        rows.append((k, [float(x) for x in (centres[rng.integers(6)] + rng.normal(size=width) * 0.7).astype(np.float32) / 3], int(rng.integers(4))))
    return rows + [(n + k, rows[k % 7][1], k % 4) for k in range(copies)]


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("row", F.lit("own")).withColumn("score", F.lit(1)).repartition(3)
    return sorted(tuple(r) for r in hardneg.mine(spark, df, F.col("vec_id") % 100 == 0, **more).collect())


def test_negatives_against_every_row(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "TILE", 3)
    monkeypatch.setattr(hardneg, "ROWS", 100)
    rows = drawn(1500, 12, 1, copies=300)
    want = slow(rows)
    assert len(want) > 100 and mined(spark, rows, block=4) == want
    assert mined(spark, rows) == want


def test_other_windows_and_numbers(spark):
    rows = drawn(700, 5, 2, copies=50)
    assert mined(spark, rows, near=3, low=50, high=95) == slow(rows, 3, 50, 95)


def test_hard_negatives_on_odd_rows(spark):
    rows = drawn(300, 4, 3) + [(None, [1.0] * 4, 1), (400, None, 1), (401, [1.0, None, 0.0, 0.0], 1), (402, [float("nan")] * 4, 2), (403, [float("inf"), 0.0, 0.0, 0.0], 2), (404, [1.0] * 4, None), (200, [0.5] * 4, 0), (200, [0.5] * 4, 0), (500, [2.0, 1.0], 3), (600, [], 2), (700, [-1.0] * 4, 77), (800, [0.0] * 4, 5), (801, [0.0] * 4, 5), (802, [0.0] * 4, 6)]
    got, want = mined(spark, rows), slow(rows)
    assert got == want and {k for k, *_ in got} >= {0, 100, 200, 800}
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [], 1), (101, [], 1), (102, [], 2)]) == slow([(100, [], 1), (101, [], 1), (102, [], 2)])


def test_bounds_hold_and_leave_few_rows():
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(size=(4000, 32)) * 40).astype(np.int64)
    cells = hardneg.Cells.of(vectors[:500], vectors.min(axis=0), vectors.max(axis=0))
    codes = cells.codes(vectors)
    at = np.arange(32)
    assert (cells.low[at, codes] <= vectors).all() and (vectors <= cells.high[at, codes]).all()
    block = hardneg.Block(np.arange(10), np.zeros(10, np.int64), vectors[:10], cells, 5)
    parts = block.parts()
    least, most = hardneg._bounds(parts, hardneg._edges(cells, codes, parts[0].dtype))
    exact = vectors[:10] @ vectors.T
    assert (least <= exact).all() and (exact <= most).all()
    assert (most >= hardneg._nth_largest(least, 5)[:, None]).sum(axis=1).max() < 400


@pytest.mark.parametrize("values", [[3.0, 7.5, -2.25], [0.0], []])
def test_cells_of_few_values(values):
    vectors = np.floor(np.array(values)[:, None] * 256).astype(np.int64)
    cells = hardneg.Cells.of(vectors, vectors.min(axis=0, initial=0), vectors.max(axis=0, initial=0))
    codes = cells.codes(vectors)
    assert ((cells.low[[0], codes] <= vectors) & (vectors <= cells.high[[0], codes])).all()
