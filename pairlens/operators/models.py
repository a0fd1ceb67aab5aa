"""Decision models on feature columns with MLlib: candidates, out-of-fold scores, ensembles, selection, refit.

Boosted trees and logistic regression are MLlib's; regularisation is set so
that a candidate's C means the weight of the data, as is usual for logistic
regression, and classes are weighted alike.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.keys import VARIANTS, verdict
from pairlens.operators.metrics import classwise_metrics
from pairlens.operators.thresholds import best_balanced_by

WEIGHTS = [0.25, 0.5, 0.75]


@dataclass(frozen=True)
class Candidate:
    name: str
    family: str
    params: dict[str, float] = field(default_factory=dict, hash=False)


def base_candidates() -> list[Candidate]:
    """Seven logistic regressions and eight forests of boosted trees."""
    out = [Candidate(f"logreg_C{c:g}", "logistic", {"C": c}) for c in (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)]
    # Trees, depth, step, rows in a leaf, share of rows, share of columns, leaf penalty.
    grid = [
        (120, 2, 0.03, 3, 0.8, 0.8, 1.0), (200, 2, 0.03, 3, 0.8, 1.0, 2.0), (120, 2, 0.07, 3, 1.0, 0.8, 2.0), (200, 2, 0.07, 5, 0.8, 0.8, 4.0),
        (120, 3, 0.03, 3, 0.8, 0.8, 2.0), (200, 3, 0.03, 5, 0.8, 1.0, 4.0), (120, 3, 0.07, 5, 1.0, 0.8, 4.0), (200, 3, 0.07, 8, 0.8, 0.8, 8.0),
    ]
    names = ("trees", "depth", "step", "leaf", "rows", "columns", "penalty")
    return out + [Candidate(f"xgb_{i:02d}", "trees", dict(zip(names, row, strict=True))) for i, row in enumerate(grid)]


def distinct_params(center: dict[str, float], options: dict[str, list[float]]) -> list[dict[str, float]]:
    """center, and center with one option changed at a time; each once, in order."""
    out = [center]
    for k, values in options.items():
        out += [x for v in values if (x := center | {k: v}) not in out]
    return out


def with_class_weights(rows: DataFrame, y: str = "y") -> DataFrame:
    n, pos = rows.agg(F.count("*"), F.count_if(F.col(y) == 1)).first()
    if not pos or pos == n:
        raise ValueError("a model needs both classes")
    return rows.withColumn("class_weight", F.when(F.col(y) == 1, F.lit(n / (2 * pos))).otherwise(F.lit(n / (2 * (n - pos)))))


def estimator(candidate: Candidate, features: list[str], rows: int, y: str = "y", seed: int = 42) -> Pipeline:
    assemble = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="error")
    scale = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True)
    common = {"featuresCol": "__scaled", "labelCol": y, "weightCol": "class_weight"}
    p = candidate.params
    if candidate.family == "logistic":
        model = LogisticRegression(**common, regParam=1 / (p["C"] * rows), standardization=False, maxIter=100)
    else:
        columns = "all" if p["columns"] >= 1 else str(p["columns"])
        model = GBTClassifier(**common, maxIter=int(p["trees"]), maxDepth=int(p["depth"]), stepSize=p["step"], minInstancesPerNode=int(p["leaf"]), subsamplingRate=p["rows"], featureSubsetStrategy=columns, seed=seed)
    return Pipeline(stages=[assemble, scale, model])


def fit(candidate: Candidate, rows: DataFrame, features: list[str], y: str = "y", seed: int = 42) -> PipelineModel:
    weighted = with_class_weights(rows, y).withColumn(y, F.col(y).cast("double"))
    return estimator(candidate, features, rows.count(), y, seed).fit(weighted)


def probabilities(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(rows).withColumn(name, F.get(vector_to_array("probability"), 1))
    return out.select(*rows.columns, name)


def out_of_fold(rows: DataFrame, folds: DataFrame, group: str, key: str, features: list[str], candidates: list[Candidate], y: str = "y", seed: int = 42) -> DataFrame:
    """candidate, repeat, fold, key, y and p: each row scored by models that did not see its group.

    folds: repeat, group and fold.  One fit for each candidate and fold; rows
    without a score, or with NaN, raise.  Scores are kept, as ensembles and
    their ranking read them again.
    """
    parts = []
    # subsamples of boosted trees go by places of rows, so these do not depend on the kind of join or on the order in which a shuffle arrives
    joined = rows.join(folds.withColumnRenamed("group", group).hint("merge"), group).sortWithinPartitions(key, group, y, *features).cache()
    for repeat, fold in sorted((r.repeat, r.fold) for r in folds.select("repeat", "fold").distinct().collect()):  # a row for each fold
        inside = joined.where(F.col("repeat") == repeat)
        train, test = inside.where(F.col("fold") != fold), inside.where(F.col("fold") == fold)
        for c in candidates:
            scored = probabilities(fit(c, train, features, y, seed + repeat), test)
            parts.append(scored.select(F.lit(c.name).alias("candidate"), "repeat", "fold", key, F.col(y).cast("int").alias(y), F.when(F.isnan("p"), F.raise_error(F.lit("a score is NaN"))).otherwise(F.col("p")).alias("p")))
    return reduce(DataFrame.unionByName, parts).persist()


def ensembles(oof: DataFrame, grid: DataFrame, key: str, y: str = "y") -> DataFrame:
    """Out-of-fold scores of the grid's weighted pairs, from those of their parts: nothing is fitted again."""
    a = oof.select(F.col("candidate").alias("tree"), "repeat", "fold", key, y, F.col("p").alias("pa"))
    b = oof.select(F.col("candidate").alias("linear"), "repeat", key, F.col("p").alias("pb"))
    both = grid.select("name", "tree", "linear", "weight").join(a, "tree").join(b, ["linear", "repeat", key])
    return both.select(F.col("name").alias("candidate"), "repeat", "fold", key, y, (F.col("weight") * F.col("pa") + (1 - F.col("weight")) * F.col("pb")).alias("p"))


def mix_probabilities(parts: list[Column], weight: float | None = None) -> Column:
    """One probability as it is, or two mixed by the weight of the first."""
    if len(parts) == 1:
        return parts[0]
    if len(parts) != 2 or weight is None:
        raise ValueError("an ensemble has one or two parts")
    return F.lit(weight) * parts[0] + F.lit(1 - weight) * parts[1]


def select_candidates(oof: DataFrame, key: str, y: str = "y") -> DataFrame:
    """A row for each candidate, best first: threshold by balance of its mean scores, and metrics there."""
    mean = oof.groupBy("candidate", key, y).agg(F.avg("p").alias("score"))
    order = [F.desc(c) for c in ("min_class_f1", "macro_f1", "accuracy", "f1", "candidate")]
    return best_balanced_by(mean, "candidate", y, "score").orderBy(*order)  # a row for each candidate


def save(model: PipelineModel, path: str, threshold: float, meta: dict | None = None) -> None:
    """The model, and its threshold with what is known of it as one line of JSON beside it."""
    model.write().overwrite().save(f"{path}/model")
    text = json.dumps({"format": 1, "decision_threshold": threshold} | (meta or {}), sort_keys=True)
    SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/threshold")


def load(path: str) -> tuple[PipelineModel, float]:
    line = SparkSession.active().read.text(f"{path}/threshold").first()[0]
    return PipelineModel.load(f"{path}/model"), json.loads(line).get("decision_threshold", 0.5)


def predict(rows: DataFrame, model: PipelineModel | None, threshold: float = 0.5, fallback: str = "score_sem") -> DataFrame:
    """rows with prob_keep, verdict and pred_label; without a model the fallback score decides at one half."""
    scored = rows.withColumn("prob_keep", F.col(fallback)) if model is None else probabilities(model, rows, "prob_keep")
    v = verdict(F.col("prob_keep"), 0.5 if model is None else threshold)
    return scored.withColumns({"verdict": v["verdict"], "pred_label": v["label"]})


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Impurity-based importances of boosted trees, largest first (not attributions)."""
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def majority_vote(rows: DataFrame, scores: list[str], y: str = "y", threshold: float = 0.5) -> DataFrame:
    votes = reduce(lambda a, b: a + b, [(F.col(s) >= threshold).cast("int") for s in scores])
    return classwise_metrics(rows.withColumn("predicted", 3 * votes >= 2 * len(scores)), y)


def ablations(train: DataFrame, held: DataFrame, features: list[str], candidate: Candidate, y: str = "y") -> DataFrame:
    """A row of held-out metrics for each variant of the features, single score, and majority vote."""
    scores = [c for c in ("score_sem", "score_struct", "score_obj") if c in features]
    parts = []
    for name, without in VARIANTS.items():
        own = [f for f in features if f not in without]
        scored = probabilities(fit(candidate, train, own, y), held)
        parts.append(classwise_metrics(scored.withColumn("predicted", F.col("p") >= 0.5), y).withColumn("variant", F.lit(name)))
    for s in scores:
        parts.append(classwise_metrics(held.withColumn("predicted", F.col(s) >= 0.5), y).withColumn("variant", F.lit(s)))
    if len(scores) == 3:
        parts.append(majority_vote(held, scores, y).withColumn("variant", F.lit("majority")))
    return reduce(DataFrame.unionByName, parts)


def judged(rows: DataFrame, verdict_: str = "verdict", invalid: str = "regenerate") -> DataFrame:
    """rows with predicted (match) from parsed verdicts; invalid ones count as "pass" or "regenerate", or go with "exclude"."""
    if invalid not in ("pass", "regenerate", "exclude"):
        raise ValueError(invalid)
    v = F.col(verdict_)
    if invalid == "exclude":
        rows = rows.where(v.isNotNull())
    return rows.withColumn("valid", v.isNotNull()).withColumn("predicted", F.coalesce(v, F.lit(invalid)) == "pass")
