"""Whole runs: judged answers, a scorer's threshold, selection and refit of a decision model, claim examples.

Each takes and gives DataFrames; what a run knows about itself is provenance().
"""

from __future__ import annotations

import os
import platform
import shutil
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions import jsontools
from pairlens.functions.claimgraph import claim_examples
from pairlens.operators import bootstrap, matching, metrics, models, splits, thresholds


def judge_report(expected: DataFrame, log: DataFrame, invalid: str = "regenerate", key: str = "record_key", ordinal: str = "ordinal") -> DataFrame:
    """Metrics of stored answers: the last record of each expected key, parsed; target is 1 for mismatch.

    With them the numbers of valid and invalid verdicts before the policy for
    invalid ones applies.
    """
    rows = matching.in_expected_order(expected.select(key), log, key, ordinal)
    rows = rows.select(key, (1 - F.col("record.target")).alias("y"), jsontools.parse_answer(F.col("record.raw_output")).alias("r"))
    rows = rows.withColumn("verdict", F.col("r.parsed.verdict"))
    validity = rows.agg(F.count_if(F.col("verdict").isNotNull()).alias("n_valid"), F.count_if(F.col("verdict").isNull()).alias("n_invalid"))
    return metrics.classwise_metrics(models.judged(rows, invalid=invalid)).crossJoin(F.broadcast(validity))  # one row each


def score_report(validation: DataFrame, held: DataFrame, objective: str = "f1", y: str = "y", score: str = "score") -> DataFrame:
    """Metrics of held at the threshold that validation chose, which comes with them; held takes no part in the choice."""
    best = thresholds.best_midpoint(validation, y, score, objective).first()
    out = metrics.at_threshold(held, best.threshold, y, score)
    return out.withColumns({"threshold": F.lit(best.threshold), "validation_f1": F.lit(best.f1)})


def object_score(similarities: Column, scale: float, most: int = 8, top: int = 3) -> Column:
    """struct(score, confidence) from similarities to the nouns of a caption: mean of the top sigmoids, confidence by their spread."""
    p = F.transform(F.slice(similarities, 1, most), lambda s: 1 / (1 + F.exp(-s * scale)))
    best = F.slice(F.sort_array(p, asc=False), 1, top)
    mean = F.try_divide(F.aggregate(best, F.lit(0.0), lambda a, x: a + x), F.size(best).cast("double"))
    spread = F.array_max(p) - F.array_min(p)
    return F.struct(F.coalesce(mean, F.lit(0.5)).alias("score"), F.when(F.size(p) > 1, spread).otherwise(0.15).alias("confidence"))


def tune(rows: DataFrame, features: list[str], group: str, key: str, repeats: int = 5, k: int = 5, y: str = "y", seed: int = 42, candidates: list[models.Candidate] | None = None) -> dict:
    """Candidates and their ensembles by out-of-fold scores: ranked candidates, the scores, and intervals and stability of the best."""
    candidates = candidates or models.base_candidates()
    spark = rows.sparkSession
    folds = splits.repeated_folds(rows, group, repeats, k, y, seed)
    oof = models.out_of_fold(rows, folds, group, key, features, candidates, y, seed)
    names = spark.createDataFrame([(c.name, c.family) for c in candidates], "name string, family string")
    grid = matching.tree_linear_grid(names.where("family = 'trees'"), names.where("family = 'logistic'"), models.WEIGHTS)
    every = oof.unionByName(models.ensembles(oof, grid, key, y)).cache()
    ranked = models.select_candidates(every, key, y)
    best = ranked.first()
    own = every.where(F.col("candidate") == best.candidate).withColumn("predicted", F.col("p") >= best.threshold)
    per_fold = metrics.classwise_metrics(own, y, by=["repeat", "fold"])
    grouped = own.where("repeat = 0").join(rows.select(key, group), key)
    return {"ranked": ranked, "scores": every, "best": best, "stability": bootstrap.stability(per_fold), "intervals": bootstrap.group_intervals(grouped, group, y)}


def refit(rows: DataFrame, features: list[str], names: list[str], path: str, threshold: float, weight: float | None = None, y: str = "y", candidates: list[models.Candidate] | None = None) -> None:
    """Fits the chosen candidates (one, or a tree and a linear one) on all rows and saves them; the threshold stays as it was chosen."""
    by_name = {c.name: c for c in candidates or models.base_candidates()}
    for i, name in enumerate(names):
        models.save(models.fit(by_name[name], rows, features, y), f"{path}/{i}", threshold, {"candidate": name, "weight": weight, "features": features})


def score_refit(rows: DataFrame, path: str, parts: int, weight: float | None = None) -> DataFrame:
    """rows with prob_keep and the verdict at the saved threshold."""
    threshold = 0.5
    for i in range(parts):
        model, threshold = models.load(f"{path}/{i}")
        rows = models.probabilities(model, rows, f"__p{i}")
    p = models.mix_probabilities([F.col(f"__p{i}") for i in range(parts)], weight)
    v = models.verdict(p, threshold)
    return rows.withColumns({"prob_keep": p, "verdict": v["verdict"], "pred_label": v["label"]}).drop(*[f"__p{i}" for i in range(parts)])


def graph_examples(figures: DataFrame, ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """Claims of split figures (figure_key, split, claims) as examples with graphs; a figure's claims stay on one side."""
    family = F.split_part("figure_key", F.lit("/"), F.lit(1))
    split = splits.figure_split(figures.withColumnRenamed("split", "split_folder").withColumn("family", family), "figure_key", "family", ratio, seed)
    return claim_examples(split.drop("family"))


def variants_report(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("variant", F.lit(name)) for name, df in parts.items()])


def provenance(sources: dict[str, str], policy: str) -> dict:
    """What a report says of its run: arguments, versions, hashes of its sources, and how leakage was ruled out."""
    from importlib.metadata import PackageNotFoundError, version

    def of(name: str) -> str | None:
        try:
            return version(name)
        except PackageNotFoundError:
            return None

    return {"argv": sys.argv, "python": platform.python_version(), "packages": {p: of(p) for p in ("pyspark", "numpy", "pandas", "pyarrow")}, "sources": sources, "leakage_policy": policy}


def promote(run_dir: str, target_dir: str, names: list[str]) -> list[str]:
    """Copies the artifacts that exist from a run's folder to the shared one; folders are replaced whole."""
    os.makedirs(target_dir, exist_ok=True)
    done = []
    for name in names:
        source, target = os.path.join(run_dir, name), os.path.join(target_dir, name)
        if os.path.isdir(source):
            shutil.rmtree(target, ignore_errors=True)
            shutil.copytree(source, target)
        elif os.path.exists(source):
            shutil.copy2(source, target)
        else:
            continue
        done.append(name)
    return done
