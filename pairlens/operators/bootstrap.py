"""Bootstrap intervals.

Rows: a replicate draws as many rows of each class as there are, with
replacement, so the confusion counts of a class are a multinomial draw over the
counts of the rows as they are.  Rows are counted once, whatever the number of
replicates, and what the draws need is four numbers, or eight for two predictors.

Groups: a replicate draws as many groups as there are, with replacement.  Groups
of equal confusion counts are alike, so the draws are a multinomial over the
compositions that occur.  Compositions are spread over CELLS by hash; how many
draws fall to each cell is one multinomial, and each cell deals its own among
its compositions.  Groups are counted once, and drawing costs as much as there
are different compositions.

Replicates without rows of a class are left out of its intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.metrics import confusion, from_confusion

METRICS = ["accuracy", "precision", "recall", "f1", "precision_mismatch", "recall_mismatch", "f1_mismatch", "macro_f1", "min_class_f1"]
#: Hash cells that compositions are dealt from, each in one task.
CELLS = 64
COUNTS = ["tp", "fp", "fn", "tn"]


def _weighted(rows: DataFrame, y: str, predicted: str, prefix: str = "") -> list[Column]:
    t, p = F.col(y).cast("boolean"), F.col(predicted).cast("boolean")
    return [F.sum(F.when(c, F.col("w")).otherwise(0)).alias(prefix + name) for name, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))]


def compositions(rows: DataFrame, group: str, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn and groups: how many groups have these counts."""
    return rows.groupBy(group).agg(*confusion(F.col(y), F.col(predicted))).groupBy(*COUNTS).agg(F.count("*").alias("groups"))


def group_replicates(table: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """replicate, drawn (the number of groups, each time that of all groups) and the confusion counts of each replicate, from compositions()."""
    import numpy as np
    import pandas as pd

    celled = table.withColumn("cell", F.pmod(F.xxhash64(*COUNTS), F.lit(CELLS)).cast("int"))
    sizes = {r.cell: r.n for r in celled.groupBy("cell").agg(F.sum("groups").alias("n")).collect()}  # CELLS rows at most
    if not sizes:
        raise ValueError("there are no groups to draw from")
    cells, total = sorted(sizes), sum(sizes.values())
    drawn = np.random.default_rng(seed).multinomial(total, [sizes[c] / total for c in cells], n)
    of_cell = {c: drawn[:, i].tolist() for i, c in enumerate(cells)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(COUNTS)
        cell, p = int(pdf["cell"].iloc[0]), (pdf["groups"] / pdf["groups"].sum()).to_numpy()
        rng, counts = np.random.default_rng([seed, cell]), pdf[COUNTS].to_numpy()
        times = np.stack([rng.multinomial(k, p) for k in of_cell[cell]])
        return pd.DataFrame({"replicate": np.arange(n), "drawn": times.sum(1), **dict(zip(COUNTS, (times @ counts).T, strict=True))})

    parts = celled.groupBy("cell").applyInPandas(run, "replicate long, drawn long, tp long, fp long, fn long, tn long")
    return parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("drawn", *COUNTS)])


def intervals(samples: DataFrame, metrics: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """metric, low and high: percentiles with linear interpolation."""
    tail = (1 - level) / 2
    metrics = metrics or METRICS
    one = samples.agg(*[F.percentile(m, F.array(F.lit(tail), F.lit(1 - tail))).alias(m) for m in metrics])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.get(m, 0).alias("low"), F.get(m, 1).alias("high")) for m in metrics])).alias("x")).select("x.*")


def stratified(rows: DataFrame, y: str, predicted: list[str], n: int, seed: int) -> DataFrame:
    """replicate and, for each predictor i, {i}_tp, {i}_fp, {i}_fn and {i}_tn, with the class sizes that rows have."""
    import numpy as np

    spark = rows.sparkSession
    flags = [F.col(c).cast("boolean").alias(f"f{i}") for i, c in enumerate([y, *predicted])]
    counts = {tuple(r[:-1]): r[-1] for r in rows.select(*flags).groupBy(*[f"f{i}" for i in range(len(flags))]).count().collect()}  # a row for each combination
    rng = np.random.default_rng(seed)
    drawn = {}
    for label in (False, True):
        cells = sorted(k for k in counts if k[0] is label and None not in k)
        size = sum(counts[k] for k in cells)
        if size:
            drawn[label] = cells, rng.multinomial(size, [counts[k] / size for k in cells], n)
    columns = {}
    for i in range(len(predicted)):
        for name, label, said in (("tp", True, True), ("fp", False, True), ("fn", True, False), ("tn", False, False)):
            cells, draws = drawn.get(label, ([], np.zeros((n, 0), np.int64)))
            columns[f"{i}_{name}"] = draws[:, [j for j, k in enumerate(cells) if k[i + 1] is said]].sum(axis=1)
    values = [tuple(map(int, x)) for x in zip(range(n), *columns.values(), strict=True)]
    return spark.createDataFrame(values, ", ".join(f"`{c}` long" for c in ["replicate", *columns]))


def _of(samples: DataFrame, i: int) -> DataFrame:
    return samples.select("replicate", *[F.col(f"{i}_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")]).withColumns(from_confusion())


def confidence_intervals(rows: DataFrame, y: str = "y", predicted: str = "predicted", n: int = 1000, seed: int = 42) -> DataFrame:
    return intervals(_of(stratified(rows, y, [predicted], n, seed), 0))


def group_intervals(rows: DataFrame, group: str, y: str = "y", predicted: str = "predicted", n: int = 1000, seed: int = 42) -> DataFrame:
    return intervals(group_replicates(compositions(rows, group, y, predicted), n, seed).withColumns(from_confusion()))


def paired_deltas(rows: DataFrame, y: str, first: str, second: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """metric, delta (second less first on the rows as they are), low and high, both predictors on the same draws."""

    def deltas(samples: DataFrame) -> DataFrame:
        one, two = (_of(samples, i).select("replicate", *[F.col(m).alias(f"{i}:{m}") for m in METRICS]) for i in (0, 1))
        return one.join(two, "replicate").select(*[(F.col(f"1:{m}") - F.col(f"0:{m}")).alias(m) for m in METRICS])

    own = rows.withColumn("w", F.lit(1))
    point = deltas(own.agg(*_weighted(own, y, first, "0_"), *_weighted(own, y, second, "1_")).withColumn("replicate", F.lit(0)))
    point = point.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("delta")) for m in METRICS])).alias("x")).select("x.*")
    return point.join(intervals(deltas(stratified(rows, y, [first, second], n, seed))), "metric")


def stability(per_fold: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """mean, population deviation, min and max of each metric over folds and repeats."""
    metrics = metrics or ["accuracy", "macro_f1", "min_class_f1", "f1", "f1_mismatch"]
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
    return per_fold.select(F.explode(parts).alias("x")).groupBy("x.metric").agg(F.avg("x.v").alias("mean"), F.stddev_pop("x.v").alias("std"), F.min("x.v").alias("min"), F.max("x.v").alias("max"))
