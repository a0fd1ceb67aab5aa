import pytest
from pyspark.sql import functions as F

from pairlens.operators import bootstrap, metrics, splits, thresholds

# published confusion counts: n, tp, fp, fn, tn and accuracy, F1 of either class to four digits
PUBLISHED = [
    (141, 107, 1, 45, 0.6327, 0.7231, 0.4545), (130, 89, 12, 63, 0.6565, 0.7202, 0.5551), (117, 83, 25, 69, 0.6327, 0.6842, 0.5610),
    (142, 152, 0, 0, 0.4830, 0.6514, 0.0), (72, 52, 70, 100, 0.5850, 0.5414, 0.6211), (262, 34, 73, 189, 0.8082, 0.8304, 0.7794),
]


def rows(spark, y, s):
    return spark.createDataFrame(list(zip(y, s)), "y int, score double")


def test_classwise(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, predicted int")
    m = metrics.classwise_metrics(df).first()
    assert (m.precision, m.recall) == (1.0, 0.5) and m.f1 == pytest.approx(2 / 3)
    assert m.precision_mismatch == pytest.approx(2 / 3) and m.f1_mismatch == pytest.approx(0.8)
    assert m.macro_f1 == pytest.approx((2 / 3 + 0.8) / 2) and m.min_class_f1 == pytest.approx(2 / 3)


def test_published(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(PUBLISHED)], "i int, tp long, fp long, fn long, tn long").withColumns(metrics.from_confusion())
    for r, want in zip(df.orderBy("i").collect(), PUBLISHED):
        assert (r.accuracy, r.f1, r.f1_mismatch) == pytest.approx(want[4:], abs=1e-4)


def test_no_rows(spark):
    m = metrics.classwise_metrics(spark.createDataFrame([], "y int, predicted int")).first()
    assert m.n == 0 and m.accuracy == 0 and m.f1 == 0


def test_thresholds(spark):
    a = rows(spark, [0, 0, 0, 1, 1, 1], [0.05, 0.2, 0.55, 0.45, 0.7, 0.9])
    best = thresholds.best_balanced(a).first()
    assert best.threshold == 0.45 and best.f1 == pytest.approx(6 / 7) and best.f1_mismatch == pytest.approx(0.8)
    b = rows(spark, [0, 0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.8, 0.4, 0.7])
    best = thresholds.best_balanced_scores(b).first()
    assert best.threshold == 0.4 and best.f1 == pytest.approx(0.8) and best.f1_mismatch == pytest.approx(6 / 7)
    c = rows(spark, [0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9])
    best = thresholds.best_balanced_grid(c).first()
    assert 0.4 < best.threshold <= 0.6 and best.min_class_f1 == 1.0
    assert thresholds.best_midpoint(c).first().threshold == pytest.approx(0.5)
    assert thresholds.best_f1(c).first().threshold == 0.5


def test_thresholds_refuse(spark):
    with pytest.raises(ValueError):
        thresholds.best_balanced_grid(rows(spark, [1, 1], [0.1, 0.2]))
    with pytest.raises(ValueError):
        thresholds.best_balanced_scores(rows(spark, [1, 0], [0.1, float("nan")]))


def test_ranges_give_the_same_sums(spark, monkeypatch):
    from pairlens.operators import prefix

    df = spark.range(500).select((F.col("id") * 37 % 500).cast("double").alias("t"), (F.col("id") % 7).alias("v"))
    whole = {r.t: r.cum_v for r in prefix.prefix_sums(df, "t", ["v"], descending=True).collect()}
    monkeypatch.setattr(prefix, "RANGE_ROWS", 60)
    assert {r.t: r.cum_v for r in prefix.prefix_sums(df, "t", ["v"], descending=True).collect()} == whole


def test_auc(spark):
    assert metrics.roc_auc(rows(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])).first().roc_auc == 0.75
    assert metrics.roc_auc(rows(spark, [0, 1], [0.5, 0.5])).first().roc_auc == 0.5
    assert metrics.roc_auc(rows(spark, [1, 1], [0.5, 0.6])).first().roc_auc is None


def test_hinge(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 0.0), ("b", 1, 0.0), ("b", 0, 1.0), ("c", 1, 5.0)], "g string, y int, logit double")
    assert metrics.pair_hinge(df.where("g = 'a'"), "g").first().loss == 0
    assert metrics.pair_hinge(df.where("g = 'b'"), "g").first().loss == pytest.approx(1.2)
    assert metrics.pair_hinge(df, "g").first().n_groups == 2


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, i % 2, i % 2, 1) for i in range(6)], "id int, y int, good int, flat int")
    d = {r.metric: r for r in bootstrap.paired_deltas(df, "y", "flat", "good", n=50).collect()}
    assert d["accuracy"].delta == pytest.approx(0.5) and d["f1"].delta > 0
    a = {r.metric: (r.low, r.high) for r in bootstrap.confidence_intervals(df, predicted="good", n=50).collect()}
    b = {r.metric: (r.low, r.high) for r in bootstrap.confidence_intervals(df, predicted="good", n=50).collect()}
    assert a == b and a["accuracy"] == (1.0, 1.0)
    rows = spark.createDataFrame([(int(i % 4 > 0), int(i % 3 > 0)) for i in range(400)], "y int, predicted int")
    drawn = bootstrap.stratified(rows, "y", ["predicted"], 300, 1).collect()
    assert {(r["0_tp"] + r["0_fn"], r["0_fp"] + r["0_tn"]) for r in drawn} == {(300, 100)}  # class sizes are kept
    tp = [r["0_tp"] for r in drawn]
    real = rows.where("y = 1 and predicted = 1").count()
    assert abs(sum(tp) / 300 - real) < 2 and 5 < (max(tp) - min(tp)) < 80
    alone = spark.createDataFrame([(1, 1), (1, 0)], "y int, predicted int")
    assert bootstrap.stratified(alone, "y", ["predicted"], 5, 1).count() == 5


def test_grouped_split(spark):
    df = spark.createDataFrame([(f"g{i // 2}", i % 2) for i in range(16)], "g string, y int")
    out = splits.grouped_split(df, "g", ratio=0.25)
    sides = {r.g: r.is_validation for r in out.collect()}
    assert out.count() == 16 and all(out.where(f"is_validation = {s}").select("y").distinct().count() == 2 for s in ("true", "false"))
    assert len(sides) == 8 and out.groupBy("g").agg(F.count_distinct("is_validation").alias("n")).where("n > 1").isEmpty()


def test_samples(spark):
    df = spark.createDataFrame([(i, int(i < 30)) for i in range(35)], "id int, y int")
    assert splits.class_cap(df, "y", "id", 3.0).groupBy("y").count().orderBy("y").collect() == [(0, 5), (1, 15)]
    assert splits.train_test(df, "id").where("is_train").count() == 24
    out = splits.pair_batches(df.withColumn("g", F.expr("cast(id / 2 as int)")), "g", 4)
    assert out.count() == 35 and out.groupBy("batch_id").count().agg(F.max("count")).first()[0] <= 4
    pools = splits.pools(df, "id", {"a": 3, "b": 4}).groupBy("pool").count().collect()
    assert {r.pool: r["count"] for r in pools} == {"a": 3, "b": 4}
