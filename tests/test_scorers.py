import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.functions import scorers


def test_linear_in_three_forms(spark):
    linear = scorers.Linear({"a": 1.5, "b": -2.0}, 0.25, 10.0)
    rows = [([0.5, 1.0], 20.0), ([3.0, 0.0], 5.0), ([0.0, 0.0], 0.0), (None, 1.0), ([1.0, 1.0], None), ([float("nan"), 1.0], 3.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, x array<double>, n double").repartition(3)
    batch = scorers.batch_scorer(linear.scorer(spark))
    scorers.register(spark, "linear_score", batch)
    df.createOrReplaceTempView("scored_rows")
    found = [sorted((r.id, round(r.s.score, 12), round(r.s.confidence, 12)) for r in d.collect()) for d in (df.select("id", batch("x", "n").alias("s")), df.select("id", linear.column(F.col("x"), F.col("n")).alias("s")), spark.sql("SELECT id, linear_score(x, n) AS s FROM scored_rows"))]
    assert found[0] == found[1] == found[2]
    p = 1 / (1 + np.exp(-(0.75 - 2 + 0.25)))
    assert found[0][0] == (0, round(p, 12), round(abs(2 * p - 1), 12))
    assert [x[1:] for x in found[0][3:]] == [(0.5, 0.0)] * 3


def test_parameters_are_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write("x\n")
        return 2.0

    def one(k, value):
        return value / k, 1.0

    double = scorers.scalar_scorer(one, load)
    df = spark.range(4000).select((F.col("id") % 2).cast("double").alias("v")).repartition(16)
    for _ in range(2):
        assert df.select(double("v").alias("s")).agg(F.sum("s.score"), F.min("s.confidence")).first() == (1000.0, 1.0)
    assert len(open(log).read().split()) <= 4  # local[4] has so many workers at most, for 32 tasks


def test_a_batch_that_fails_is_scored_by_row():
    def many(_, columns):
        raise RuntimeError("the batch form is broken")

    def one(_, row):
        if row[0] == "bad":
            raise ValueError
        return len(row[0]) / 10, 2.0

    s = scorers.Scorer(lambda: None, many, one)
    assert s.score([pa.array(["abc", "bad", None, "x" * 20])]).to_pylist() == [{"score": 0.3, "confidence": 1.0}, {"score": 0.5, "confidence": 0.0}, {"score": 0.5, "confidence": 0.0}, {"score": 1.0, "confidence": 1.0}]
    with pytest.raises(RuntimeError):
        scorers.Scorer(lambda: None, many).score([pa.array(["abc"])])
    with pytest.raises(ValueError, match="length"):
        s.score([pa.array(["a"]), pa.array(["a", "b"])])
    short = scorers.Scorer(lambda: None, lambda _, c: (np.zeros(0), np.zeros(0)))
    with pytest.raises(ValueError, match="as many"):
        short.score([pa.array(["a"])])
