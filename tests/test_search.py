import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from pairlens.operators import models, prefix, search, splits, thresholds

NAMES = ["a", "b", "c"]
LOGISTIC = [c for c in models.base_candidates() if c.family == "logistic"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(240):
        y = int(rng.random() < 0.35)
        out.append((i, f"g{i // 4}", y, float(1000 + 30 * (rng.normal() + 0.7 * y)), float(rng.normal() - 0.5 * y), 2.0))
    return spark.createDataFrame(out, "id long, grp string, y int, a double, b double, c double").repartition(3).cache()


@pytest.fixture(scope="module")
def found(spark, rows):
    folds = splits.repeated_folds(rows, "grp", 5, 5)
    data = search.prepare(rows, folds, "grp", "id", NAMES).cache()
    return data, search.Search(data, LOGISTIC, 5, 5, NAMES)


def by_mllib(train, c, n):
    """One fit to a far smaller tolerance than usual, of models.estimator()'s form."""
    weighted = models.with_class_weights(train).withColumn("y", F.col("y").cast("double"))
    stages = [VectorAssembler(inputCols=NAMES, outputCol="r"), StandardScaler(inputCol="r", outputCol="s", withMean=True, withStd=True), LogisticRegression(featuresCol="s", labelCol="y", weightCol="class_weight", regParam=1 / (c * n), standardization=False, maxIter=2000, tol=1e-14)]
    return Pipeline(stages=stages).fit(weighted).stages[-1]


def test_as_many_scans_as_steps_and_like_single_fits(spark, rows, found):
    data, s = found
    assert s.coefficients.shape == (5, 5, 7, 4) and s.scans < 30  # 175 models
    for r, f, j in [(0, 0, 0), (1, 3, 2), (2, 1, 4), (4, 4, 6)]:
        train = data.where(F.get("fold", r) != f).select("y", *[F.get("x", i).alias(n) for i, n in enumerate(NAMES)])
        m = by_mllib(train, LOGISTIC[j].params["C"], train.count())
        assert np.abs(s.coefficients[r, f, j] - [*m.coefficients.toArray(), m.intercept]).max() < 1e-6


def test_out_of_fold(spark, rows, found):
    data, s = found
    oof = s.out_of_fold("id").cache()
    assert oof.count() == 240 * 5 * 7 and oof.where("p IS NULL OR p <= 0 OR p >= 1").isEmpty()
    w, constant = s.raw()
    local = {r.id: r for r in data.collect()}
    for r in oof.where("candidate = 'logreg_C1'").limit(50).collect():
        own = local[r.id]
        assert own.fold[r.repeat] == r.fold
        assert r.p == pytest.approx(1 / (1 + np.exp(-(np.dot(own.x, w[r.repeat, r.fold, 4]) + constant[r.repeat, r.fold, 4]))))
    ranked = models.select_candidates(oof, "id").collect()
    assert len(ranked) == 7 and ranked[0].min_class_f1 == max(x.min_class_f1 for x in ranked)


def test_mean_scores_are_those_of_the_repeats(spark, found):
    _, s = found
    want = {(r.candidate, r.id, r.y): r.p for r in s.out_of_fold("id").groupBy("candidate", "id", "y").agg(F.avg("p").alias("p")).collect()}
    got = {(r.candidate, r.id, r.y): r.p for r in s.mean_scores("id").collect()}
    assert got == pytest.approx(want, rel=1e-14) and len(got) == 240 * 7


def test_rows_are_read_once(spark, rows, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    folds = splits.repeated_folds(rows.mapInArrow(run, rows.schema), "grp", 5, 5)
    assert folds.count() == 60 * 5 and seen.value == 240
    monkeypatch.setattr(prefix, "RANGE_ROWS", 40)
    best = thresholds.best_balanced_by(rows.withColumn("part", F.col("id") % 2).mapInArrow(run, rows.schema.add("part", "long")), "part", score="b")
    assert best.count() == 2 and seen.value == 480


def test_what_is_missing_is_an_error(spark, rows):
    folds = splits.repeated_folds(rows, "grp", 1, 2)
    with pytest.raises(Exception, match="missing"):
        search.prepare(rows.withColumn("a", F.when(F.col("id") != 3, F.col("a"))), folds, "grp", "id", NAMES).collect()
    one = search.prepare(rows.withColumn("y", F.lit(1)), folds, "grp", "id", NAMES)
    with pytest.raises(ValueError, match="both classes"):
        search.Search(one, LOGISTIC[:1], 1, 2, NAMES)
