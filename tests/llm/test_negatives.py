import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id int, v string, g int"


def plain(rows, positives=5, negatives_=3, scale=256):
    """The contract by loops over Python integers."""
    good = {(i, y, tuple(int(np.floor(scale * x)) for x in v)) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731 - shorter ones are followed by zeros
    out = []
    for i, y, v in (r for r in good if r[0] % 50 == 0):
        rank = sorted((-dot(v, w), j, z) for j, z, w in good)
        for p, j, _ in [r for r in rank if r[2] == y and r[1] != i][:positives]:
            hits = [(-s, k) for s, k, z in rank if z != y and -50 * p <= -100 * s <= -95 * p][:negatives_]
            out += [(i, j, n + 1, k, -p, s) for n, (s, k) in enumerate(hits)]
    return sorted(out)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 7, "x", 9) for r in rows], SCHEMA).repartition(parts)
    out = negatives.mine(negatives.points(df, F.col("vec_id"), F.col("label"), F.col("embedding"), 256), F.col("id") % 50 == 0)
    return sorted(tuple(r) for r in out.collect())


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BATCH", 7)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "LEAST_SLICE", 64)
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + 0.4 * rng.normal(size=8)).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(60)]  # copies: ties go to smaller ids
    rows += [(100, rows[100][1], rows[100][2]), (150, [0.0] * 8, 1), (150, [1.0] * 8, 1)]  # a repeated row, other rows of an id
    rows += [(50_000, None, 1), (None, [1.0] * 8, 1), (50_050, [1.0] * 8, None), (50_100, [float("nan")] * 8, 1), (50_150, [None, 1.0], 1), (50_200, [float("inf")], 1), (50_250, [], 0), (50_300, [0.5, 0.5], 2)]
    assert mined(spark, rows) == plain(rows)


def test_groups_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 3)
    monkeypatch.setattr(negatives, "LEAST_SLICE", 32)
    rng = np.random.default_rng(1)
    rows = [(10 * i, np.abs(rng.normal(size=3)).tolist(), i % 3) for i in range(120)]
    assert mined(spark, rows) == plain(rows)


def test_large_components(spark):
    rows = [(i, [2.0**19 + i, float(i)], i % 2) for i in range(120)]  # products beyond 2**53
    assert mined(spark, rows) == plain(rows)
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(0, [1e30], 0)])


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 0)]) == []
    assert mined(spark, [(0, [1.0], 0), (1, [1.0], 0), (2, [0.7], 1)]) == [(0, 1, 1, 2, 65536, 256 * 179)]
    assert mined(spark, [(0, [-1.0], 0), (1, [1.0], 0), (2, [0.7], 1)]) == []  # a negative score has no band


def test_brackets_hold():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-200, 200, (300, 16)), rng.integers(-200, 200, (40, 16))
    q[0] = 0
    radius2 = float((x.astype(float) ** 2).sum(1).max())
    space = negatives.Space(negatives.choose_pivots(x[:100], radius2), radius2, False)
    d, scale, squares, slack = space.of_anchors(q)
    near = np.abs(d[:, None] - space.of_rows(x)).max(2).astype(float)
    far = (d[:, None] + space.of_rows(x)).min(2).astype(float)
    score = q @ x.T
    assert (score <= (squares[:, None] - near**2) / (2 * scale[:, None]) + slack[:, None]).all()
    assert (score >= (squares[:, None] - far**2) / (2 * scale[:, None]) - slack[:, None]).all()
    assert len(negatives.choose_pivots(np.ones((5, 2)), 2.0)) == 1
