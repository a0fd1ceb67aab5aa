from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pairlens.operators import attributions, models

N = 6
NAMES = [f"f{i}" for i in range(N)]


def brute_force(nodes, x):
    """Shapley values over all sets of features; a node whose feature is unknown is passed by the shares of training rows."""
    by_id = {(r.tree, r.id): r for r in nodes}

    def value(r, known):
        if r.feature is None:
            return r.value
        left, right = by_id[r.tree, r.left], by_id[r.tree, r.right]
        if r.feature in known:
            return value(left if x[r.feature] <= r.threshold else right, known)
        return (left.cover * value(left, known) + right.cover * value(right, known)) / r.cover

    def game(known):
        return sum(r.weight * value(r, known) for (_, i), r in by_id.items() if i == 0)

    out = np.zeros(N)
    for i in range(N):
        others = [j for j in range(N) if j != i]
        for k in range(N):
            for s in combinations(others, k):
                out[i] += factorial(k) * factorial(N - 1 - k) / factorial(N) * (game({*s, i}) - game({*s}))
    return out, game(set())


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, N))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.2).astype(int)
    rows = spark.createDataFrame([(int(t), *map(float, v)) for t, v in zip(y, x)], "y int, " + ", ".join(f"{n} double" for n in NAMES)).cache()
    model = models.fit(models.Candidate("t", "trees", {"trees": 4, "depth": 3, "step": 0.3, "leaf": 3, "rows": 1.0, "columns": 1.0}), rows, NAMES)
    path = str(tmp_path_factory.mktemp("trees") / "m")
    leaves = attributions.of_model(model.stages[-1], path)
    scaled = model.transform(rows).select(vector_to_array("__scaled").alias("x"), F.get(vector_to_array("rawPrediction"), 1).alias("margin"))
    return attributions.node_table(spark, path).collect(), leaves, scaled


def test_like_brute_force(spark, fitted):
    nodes, leaves, scaled = fitted
    some = scaled.limit(12).collect()
    got = attributions.shapley(leaves, np.asarray([r.x for r in some]))
    for r, own in zip(some, got):
        want, base = brute_force(nodes, r.x)
        assert np.abs(own - want).max() < 1e-12 and base == pytest.approx(attributions.expected(leaves), abs=1e-12)


def test_sums_are_margins(spark, fitted):
    _, leaves, scaled = fitted
    rows = attributions.attribute(scaled, leaves, F.col("x"), N).collect()
    base = attributions.expected(leaves)
    assert len(rows) == 400 and all(sum(r.attributions) + base == pytest.approx(r.margin, abs=1e-9) for r in rows)


def test_summary(spark, fitted):
    _, leaves, scaled = fitted
    out = attributions.summary(attributions.attribute(scaled, leaves, F.col("x"), N), NAMES).collect()
    assert [r.feature for r in out[:3]] != NAMES[3:] and {r.feature for r in out[:3]} == {"f0", "f1", "f2"}
    with pytest.raises(Exception, match="missing"):
        attributions.attribute(spark.createDataFrame([([float("nan")] * N,)], "x array<double>"), leaves, F.col("x"), N).collect()
