import json

import pytest
from pyspark.sql import functions as F

from pairlens.operators import models, splits
from pairlens.plans import queries, runs


def test_judge_report(spark):
    log = [("a", 1, '{"verdict": "regenerate"}', 1), ("b", 0, "??", 2), ("b", 0, '{"verdict": "pass"}', 3), ("c", 0, "none", 4)]
    df = spark.createDataFrame(log, "record_key string, target int, raw_output string, ordinal long")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "record_key string")
    r = runs.judge_report(keys, df).first()
    assert (r.tp, r.tn, r.fn, r.fp, r.n_valid, r.n_invalid) == (1, 1, 1, 0, 2, 1)
    assert runs.judge_report(keys, df, "exclude").first().n == 2 and runs.judge_report(keys, df, "pass").first().tp == 2


def test_score_report(spark):
    val = spark.createDataFrame([(0, 0.2), (1, 0.8)], "y int, score double")
    r = runs.score_report(val, spark.createDataFrame([(1, 0.4), (0, 0.6), (1, 0.7)], "y int, score double")).first()
    assert r.threshold == pytest.approx(0.5) and (r.tp, r.fp, r.fn) == (1, 1, 1)


def test_object_score(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([],)], "s array<double>")
    a, b = [x[0] for x in df.select(runs.object_score(F.col("s"), 10.0)).collect()]
    assert (a.score, a.confidence) == (0.5, 0.0) and (b.score, b.confidence) == (0.5, 0.15)


def test_refit(spark, tmp_path):
    rows = spark.createDataFrame([(f"g{i // 2}", i, i % 2, i % 2 + (i * 37 % 10) / 20) for i in range(40)], "g string, id int, y int, x double")
    chosen = models.Candidate("logreg_C1", "logistic", {"C": 1.0})
    runs.refit(rows, ["x"], ["logreg_C1"], str(tmp_path), 0.4, candidates=[chosen])
    out = runs.score_refit(rows, str(tmp_path), 1)
    assert out.where("(verdict = 'PASS') != (prob_keep >= 0.4)").isEmpty()
    assert out.where("(pred_label = 'match') = (y = 1)").count() > 30


def test_scores_are_kept_and_the_same_in_any_order_of_rows(spark):
    rows = spark.createDataFrame([(f"g{i // 5}", i, int(i * 53 % 10 < 4), (i * 37 % 101) / 101 + (i * 53 % 10 < 4) / 3) for i in range(200)], "g string, id int, y int, x double")
    trees = models.Candidate("trees", "trees", {"trees": 3, "depth": 2, "step": 0.3, "leaf": 3, "rows": 0.5, "columns": 1.0})
    out = []
    for order in (F.col("id"), F.col("id") * 73 % 211):
        own = rows.repartitionByRange(1, order).sortWithinPartitions(order)
        oof = models.out_of_fold(own, splits.repeated_folds(own, "g", 1, 2), "g", "id", ["x"], [trees])
        assert oof.is_cached
        out.append({r.id: r.p for r in oof.collect()})
    assert out[0] == out[1] and len(out[0]) == 200


def test_only_labelled_texts_are_scored(spark):
    plan = queries.scored(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and plan.rindex("regexp_extract_all") < plan.index("Join")


def test_provenance_and_promotion(tmp_path):
    (tmp_path / "run" / "model").mkdir(parents=True)
    (tmp_path / "run" / "model" / "part").write_text("m")
    (tmp_path / "run" / "t.json").write_text("{}")
    assert runs.promote(str(tmp_path / "run"), str(tmp_path / "all"), ["model", "t.json", "missing"]) == ["model", "t.json"]
    assert json.dumps(runs.provenance({"a": "b"}, "none"))
