import math
from collections import Counter, defaultdict
from fractions import Fraction
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions import features, nested
from pairlens.operators import audit, bootstrap, metrics, prefix, splits, thresholds


def greedy(compositions, k):
    """The rule group by group, in exact arithmetic; counts by fold of each composition."""
    totals = [sum(c[i] * c[2] for c in compositions) for i in (0, 1)]
    have, out = [[0, 0] for _ in range(k)], {c[:2]: [0] * k for c in compositions}

    def variance(values):
        return Fraction(sum(v * v for v in values), k) - Fraction(sum(values), k) ** 2

    for a, b, n in sorted(compositions, key=lambda c: (-min(c[:2]), -(c[0] + c[1]), -c[0])):
        for _ in range(n):
            def cost(fold):
                would = [[h[0] + a * (f == fold), h[1] + b * (f == fold)] for f, h in enumerate(have)]
                return sum(variance([Fraction(w[c], totals[c]) for w in would]) for c in (0, 1)), variance([Fraction(sum(w)) for w in would]), fold

            fold = min(range(k), key=cost)
            out[a, b][fold] += 1
            have[fold][0] += a
            have[fold][1] += b
    return out


def test_deal_is_the_greedy_rule():
    r = Random(0)
    for trial in range(60):
        kinds = {(r.randint(0, 4), r.randint(0, 3)) for _ in range(r.randint(2, 6))} | {(1, 0), (0, 1)}
        c = [(a, b, r.choice([1, 2, 3, 7, 12])) for a, b in kinds if a + b]
        c += [(30, 5, 1)] if trial % 3 == 0 else []
        k = r.randint(2, 6)
        assert audit.deal(c, k) == greedy(c, k)
    many = audit.deal([(1, 0, 10**12), (0, 1, 10**12 + 1), (10**6, 1, 3)], 5)
    assert sum(many[1, 0]) == 10**12 and max(many[0, 1]) - min(many[0, 1]) <= 1
    with pytest.raises(ValueError):
        audit.deal([(1, 0, 5)], 2)


def test_assignment_follows_the_deal(spark):
    r = Random(1)
    rows = [(f"g{g}", int(r.random() < 0.4)) for g in range(200) for _ in range(r.choice([1, 1, 1, 2, 5]))] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, y int")
    folds = audit.fold_assignment(df, "g", 4).collect()
    own = defaultdict(lambda: [0] * 4)
    for f in folds:
        own[f.match, f.mismatch][f.fold] += 1
    assert len(folds) == 201 and dict(own) == audit.deal(audit.compositions(df, "g"), 4)
    assert audit.fold_check(audit.fold_assignment(df, "g", 4)).where("valid").count() == 4
    two = splits.repeated_folds(df, "g", 2, 4).collect()
    assert len(two) == 402 and {(x.group, x.fold) for x in two if x.repeat == 0} != {(x.group, x.fold) for x in two if x.repeat == 1}
    assert [x.feasible for x in audit.feasible_folds(df, "g", most=3).collect()] == [True, True]
    few = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "g string, y int")
    assert not any(x.feasible for x in audit.feasible_folds(few, "g", most=3).collect())


def test_fields_in_one_scan(spark):
    rows = [(i, "a" if i < 6 else "b", None if i % 5 == 0 else f"t{i % 4}", int(i % 3 > 0)) for i in range(12)]
    df = spark.createDataFrame(rows, "sample_id int, k string, t string, y int")
    plan = audit.audited_fields(df, {"k": F.col("k"), "t": F.col("t")})
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    got = {r.field: r for r in plan.collect()}
    for name, at in (("k", 1), ("t", 2)):
        groups = defaultdict(Counter)
        for r in rows:
            groups[r[at]][r[3]] += 1
        h = sum(sum(c.values()) * -sum(n / sum(c.values()) * math.log2(n / sum(c.values())) for n in c.values()) for c in groups.values()) / 12
        r = got[name]
        assert (r.n_values, r.n_rows, r.duplicate_groups, r.opposite_groups) == (len(groups), 12, sum(sum(c.values()) >= 2 for c in groups.values()), sum(len(c) == 2 for c in groups.values()))
        assert r.conditional_entropy == pytest.approx(h) and r.majority_accuracy == pytest.approx(sum(max(c.values()) for c in groups.values()) / 12)
    assert got[None].match == 8 and got[None].mismatch_rate == pytest.approx(1 / 3)
    assert audit.audited_fields(df.limit(0), {"k": F.col("k")}).where("n_rows > 0").isEmpty()


def test_report_has_the_pairs(spark):
    df = spark.createDataFrame([(1, "a b c d e", 1), (2, "a b c d e f", 0), (3, "same", 1), (4, "same", 0), (5, "", 1), (6, "", 0)], "sample_id int, t string, y int")
    got = [tuple(r) for r in audit.report(df, ["t"], {"y": F.col("y")}, [F.col("t")], least=0.8).collect()]
    assert ("near:t", "", "1,2", 2) in [r[:4] for r in got] and ("balance", "match", None, 3, None) in got
    assert [(r[2], r[4]) for r in got if r[0] == "exact:t"] == [("3,4", 1.0)] and sorted(r[2] for r in got if r[0] == "contradiction") == ["3,4", "5,6"]
    assert {r[1]: r[4] for r in got if r[0] == "field"}["y.normalized_mutual_information"] == 1.0
    assert audit.label_disagreements(df.withColumn("d", F.lit(1)), "y", "d").count() == 3


def test_groups_are_drawn_whole(spark):
    r = Random(2)
    rows = spark.createDataFrame([(f"g{i // 3}", int(r.random() < 0.6), int(r.random() < 0.6)) for i in range(300)], "g string, y int, predicted int")
    table = bootstrap.compositions(rows, "g").cache()
    kinds = {tuple(x)[:4]: x.groups for x in table.collect()}
    assert sum(kinds.values()) == 100
    drawn = bootstrap.group_replicates(table, 400, 3).collect()
    assert {x.drawn for x in drawn} == {100} and len(drawn) == 400  # always the exact number of groups
    assert {x.tp + x.fp + x.fn + x.tn for x in drawn} == {300}
    sampler = np.random.default_rng(0)
    items = [k for k, n in kinds.items() for _ in range(n)]
    plain = [sum(items[j][0] for j in sampler.integers(0, 100, 100)) for _ in range(4000)]
    own = [x.tp for x in drawn]
    assert np.mean(own) == pytest.approx(np.mean(plain), rel=0.02) and np.std(own) == pytest.approx(np.std(plain), rel=0.15)
    assert [tuple(x) for x in sorted(drawn)] == [tuple(x) for x in sorted(bootstrap.group_replicates(table, 400, 3).collect())]
    low = {x.metric: (x.low, x.high) for x in bootstrap.group_intervals(rows, "g", n=50).collect()}
    assert 0 < low["accuracy"][0] < low["accuracy"][1] < 1
    with pytest.raises(ValueError):
        bootstrap.group_replicates(bootstrap.compositions(rows.limit(0), "g"))


def test_thresholds_of_all_groups_at_once(spark, monkeypatch):
    r = Random(4)
    rows = spark.createDataFrame([(f"c{i % 3}", int(r.random() < 0.5), r.choice([0.1, 0.3, 0.5, 0.75, 0.9]) if i % 2 else r.random()) for i in range(240)], "c string, y int, score double").cache()
    cols = ["threshold", "tp", "fp", "fn", "tn", "min_class_f1"]
    want = {c: tuple(thresholds.best_balanced(rows.where(F.col("c") == c)).select(*cols).first()) for c in ("c0", "c1", "c2")}
    assert {x.c: tuple(x)[1:] for x in thresholds.best_balanced_by(rows, "c").select("c", *cols).collect()} == want
    monkeypatch.setattr(prefix, "RANGE_ROWS", 40)
    assert {x.c: tuple(x)[1:] for x in thresholds.best_balanced_by(rows, "c").select("c", *cols).collect()} == want
    with pytest.raises(Exception, match="both classes"):
        thresholds.best_balanced_by(rows.withColumn("y", F.lit(1)), "c").collect()


def test_class_report(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 0, 0.2), ("a", 1, 0.4), ("b", 1, 0.7)], "g string, y int, score double")
    by = {r.g: r for r in metrics.class_report(rows, 0.5, by=["g"]).collect()}
    assert (by["a"].tp, by["a"].fp, by["a"].fn, by["a"].tn, by["a"].roc_auc) == (1, 1, 1, 1, 0.625) and by["b"].roc_auc is None and by["b"].recall == 1
    assert metrics.class_report(rows, 0.5).first().n == 5


def test_nested_metrics(spark):
    s = T.StructType([T.StructField("n", T.LongType()), T.StructField("ok", T.BooleanType()), T.StructField("node", T.StructType([T.StructField("f1", T.DoubleType()), T.StructField("deep", T.StructType([T.StructField("x", T.IntegerType())]))])), T.StructField("by_kind", T.MapType(T.StringType(), T.StructType([T.StructField("tp", T.LongType()), T.StructField("r", T.StructType([T.StructField("f1", T.DoubleType())]))]))), T.StructField("m", T.MapType(T.StringType(), T.DoubleType())), T.StructField("name", T.StringType())])
    df = spark.createDataFrame([(3, True, (0.5, (7,)), {"a": (1, (0.25,)), "b": (2, None)}, {"z": 1.5}, "text"), (4, None, None, None, {}, "t")], s)
    flat = df.select("n", "ok", "node", "name").transform(lambda d: nested.flatten(d, keep=("name",)))
    assert flat.columns == ["name", "n", "ok", "node_f1", "node_deep_x"] and tuple(flat.first()) == ("text", 3.0, 1.0, 0.5, 7.0)
    got = {(r.name, r[1]): r.value for r in nested.unpivot(df.withColumnRenamed("n", "id"), keep=("id",), skip=("by_kind", "deep")).select("name", "id", "value").collect()}
    assert got == {("ok", 3): 1.0, ("node_f1", 3): 0.5, ("node_x", 3): 7.0, ("a_tp", 3): 1.0, ("a_r_f1", 3): 0.25, ("b_tp", 3): 2.0, ("b_r_f1", 3): None, ("m_z", 3): 1.5, ("ok", 4): None, ("node_f1", 4): None, ("node_x", 4): None}
    with pytest.raises(ValueError, match="one name"):
        nested.flatten(spark.sql("SELECT struct(1 AS b) AS a, 2 AS a_b"))


def test_histograms_of_arrays(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-5, 270, n)]) for i, n in enumerate([0, 1, 5, 300])] + [(4, [7.0] * 9), (5, [None, float("nan"), 3.0, 255.999, 256.0]), (6, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    for r in features.with_histogram(df, "v").withColumn("e", features.entropy_bits(F.map_values("histogram"))).collect():
        own = rows[r.id][1]
        if own is None:
            assert r.histogram is None
            continue
        want = np.histogram([x for x in own if x is not None and 0 <= x < 256], 256, (0, 256))[0]
        p = want[want > 0] / max(want.sum(), 1)
        assert r.histogram == {i: n for i, n in enumerate(want.tolist()) if n} and r.e == pytest.approx(float(-(p * np.log2(p)).sum()), abs=1e-12)
