import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import hard_negatives as H


def brute(rows, picked):
    """Every row against every anchor, in whole numbers of any size."""
    scaled = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for a, (anchor, own, v) in enumerate(scaled):
        if not picked(anchor):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, label, k) for k, (i, label, w) in enumerate(scaled))
        for score, positive, _, _ in [x for x in scored if x[2] == own and x[3] != a][: H.POSITIVES]:
            fits = [(i, -s) for s, i, label, _ in scored if label != own and 50 * -score <= 100 * -s <= 95 * -score]
            out += [(anchor, positive, rank, i, -score, s) for rank, (i, s) in enumerate(fits[: H.NEGATIVES], 1)]
    return sorted(out)


def mined(spark, rows, schema="vec_id long, embedding array<double>, label int, row string, line int, score int", **how):
    given = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    sound = H.usable(given, "vec_id", "embedding", F.col("label"))
    return sorted(tuple(r) for r in H.mine(sound, F.col("id") % 5 == 0, **how).collect())


@pytest.mark.parametrize("wave", [16 << 20, 700])
def test_same_as_brute_force(spark, wave):
    """Copies, ties, repeated ids, odd rows and uneven lengths; in one wave of anchors and in many, by small blocks."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 9, 4 + (i % 11 == 0)).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, rows[10][1], rows[10][2]) for i in range(60)] + [(300 + i, rows[10][1], 1 - rows[10][2] % 2) for i in range(20)]
    rows += [rows[10], rows[10], (15, [0.5, -0.25, 3.0, 1.0], 2)]
    odd = [(None, [1.0], 0), (400, None, 0), (405, [1.0], None), (410, [None, 1.0], 0), (415, [float("nan")], 0), (420, [float("inf")], 0), (425, [1e308], 0)]
    assert mined(spark, rows + odd, wave_bytes=wave, blocks=H.Blocks(3, 7, 2)) == brute([(i, label, v) for i, v, label in rows], lambda i: i % 5 == 0)


def test_products_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-1000, 1 << 21, 3) * 1.0 + 1 / 256).tolist(), int(rng.integers(0, 2))) for i in range(40)]
    want = brute([(i, label, v) for i, v, label in rows], lambda i: i % 5 == 0)
    assert max(x[4] for x in want) > 1 << 54 and mined(spark, rows) == want
    ends = mined(spark, [(0, [1e30], 0), (1, [1e30], 0), (2, [1e30], 1)])
    assert ends == []  # all scores are the largest long, and that isn't in a window below itself


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(0, [], 0), (1, [], 0), (2, [], 1)]) == [(0, 1, 1, 2, 0, 0)]


def test_window_bounds_are_exact():
    for s in [*range(-205, 206), (1 << 62) + 7, -(1 << 62) - 3]:
        low, high = H._bounds(np.array([s]))
        assert int(low[0]) == -(-50 * s // 100) and int(high[0]) == 95 * s // 100
