"""Hard negatives against plain integer products over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives
from tidemark.llm.hard_negatives import products


def plain(a, c):
    return [[max(-hard_negatives.LARGEST, min(hard_negatives.LARGEST, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in c] for r in a]


@pytest.mark.parametrize("reach", [0, 1, 7, 300, 40_000, 1 << 24, 1 << 31, 1 << 50])
@pytest.mark.parametrize("dims", [1, 3, 64])
def test_products_are_exact(reach, dims):
    rng = np.random.default_rng(reach + dims)
    a = np.floor(rng.uniform(-reach, reach + 1, (5, dims)))
    c = np.floor(rng.uniform(-reach, reach + 1, (11, dims)))
    for shift in (0, reach, -3 * reach):
        assert products(a + shift, c - shift).tolist() == plain(a + shift, c - shift)


def test_fields_do_not_run_into_each_other():
    """The largest sum that a field can hold, beside the smallest, in every place."""
    top = np.full((1, 64), 255.0)
    u = np.zeros((6, 64))
    u[::2] = 255.0
    assert products(np.vstack([top, -top]), u - 128).tolist() == plain(np.vstack([top, -top]), u - 128)
    wide = hard_negatives.packed(u, 2, 22)
    assert wide.shape == (3, 64) and (wide < 2.0**44).all()


def test_products_of_other_shapes():
    assert products(np.zeros((2, 0)), np.ones((3, 4))).tolist() == [[0, 0, 0]] * 2
    assert products(np.ones((1, 2)), np.full((1, 4), 5.0)).tolist() == [[10]]
    assert products(np.ones((0, 2)), np.ones((3, 2))).shape == (0, 3)


def score(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute(rows):
    """rows: (id, vector, label); sorted result rows."""
    kept = []
    for at, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        kept.append((at, i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    found = []

    def order(r, a):
        return (-score(a[2], r[2]), r[1] is None, r[1] or 0)

    for a in kept:
        if a[1] is None or a[1] % 100:
            continue
        same = sorted((r for r in kept if r[0] != a[0] and r[3] == a[3]), key=lambda r: order(r, a))[:5]
        for p in same:
            s = score(a[2], p[2])
            fits = [r for r in kept if r[3] != a[3] and 80 * s <= 100 * score(a[2], r[2]) <= 100 * s]
            for rank, n in enumerate(sorted(fits, key=lambda r: order(r, a))[:5], 1):
                found.append((a[1], p[1], rank, n[1], s, score(a[2], n[2])))
    return sorted(found, key=repr)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(parts)
    df = df.withColumns({"score": F.lit(1), "anchors": F.lit("x"), "part": F.lit(2), "id": F.lit(0)})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives.mine(df, label, F.col("vec_id") % 100 == 0).collect()), key=repr)


def test_random_rows_and_small_blocks(spark):
    rng = random.Random(3)
    # Coarse components, so that scores tie often.
    rows = [(k * 25, [rng.randrange(-3, 4) / 4 for _ in range(6)], rng.randrange(4)) for k in range(300)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, 20) == brute(rows)


def test_a_third_is_one_vector(spark):
    rng = random.Random(4)
    rows = [(k * 10, [0.5, 0.25, 0.0] if k % 3 == 0 else [rng.random() for _ in range(3)], k % 3 if k % 2 else 1) for k in range(400)]
    got = mined(spark, rows, 5)
    assert got == brute(rows) and len(got) > 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [0.5, 0.5], 1), (200, [], 1), (300, [1.0], 2), (0, [0.5, 0.5, 0.5], 0),
        (None, [1.0, 0.5], 1), (None, [1.0, 0.5], 2), (1, [1.0, 0.5], 2), (2, [1.0, 0.5], 2), (3, None, 2), (4, [1.0, None], 2),
        (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (8, [1.0, 0.4], None), (9, [1e308, 0.0], 2), (10, [0.9, 0.5], 2), (11, [0.9, 0.4], 1),
        (12, [-1.0, -1.0], 2), (13, [-1.0, -0.5], 1), (-100, [0.1, 0.1], 3), (14, [0.3] * 5000, 2),
    ]
    assert mined(spark, rows) == brute(rows)


def test_wide_components(spark):
    rng = random.Random(6)
    rows = [(k * 50, [rng.uniform(-1e6, 1e6) for _ in range(4)], k % 3) for k in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_nothing_to_mine(spark):
    assert mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1)]) == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("label"), F.col("vec_id") == 0).count() == 0
