"""Attributions of boosted trees: how much each feature moves a row's margin from the expected one (Shapley values by paths).

A saved forest is read as a table of nodes with the number of training rows
that reached them.  A leaf contributes by its path: of the features that the
path asks about, a set is known and the row either satisfies their conditions
or not; of the others, a share of the training rows does.  The Shapley value of
that game has a closed form over the path's features, of which there are as
many as a tree is deep, so no subsets of all features are visited.  The values
of a row and the expected margin add up to the row's margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """tree, weight, id, left, right, feature, threshold, value and cover of each node of a forest that was saved at path; features by number."""
    nodes = spark.read.parquet(f"{path}/data")
    n = F.col("nodeData")
    meta = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight")
    split, leaf = n["split"], n["leftChild"] < 0
    categorical = ~leaf & (split["numCategories"] >= 0)
    threshold = F.when(categorical, F.raise_error(F.lit("splits by category have no threshold"))).otherwise(F.get(split["leftCategoriesOrThreshold"], 0))
    return nodes.join(meta, "treeID").select(
        F.col("treeID").alias("tree"), "weight", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        F.when(~leaf, split["featureIndex"]).alias("feature"), F.when(~leaf, threshold).alias("threshold"), n["prediction"].alias("value"), n["rawCount"].cast("double").alias("cover"),
    )


@dataclass
class Leaf:
    """A leaf's value, and for each feature of its path the interval (low, high] that leads there and the share of training rows that it lets through."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def leaf_paths(nodes: list) -> list[Leaf]:
    """The leaves of all trees, rows of node_table; as many as the model has."""
    by_id = {(r.tree, r.id): r for r in nodes}
    out = []

    def walk(r, path: dict[int, tuple[float, float, float]]) -> None:
        if r.feature is None:
            f = sorted(path)
            out.append(Leaf(r.value * r.weight, f, *[[path[j][k] for j in f] for k in range(3)]))
            return
        low, high, share = path.get(r.feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((r.left, (low, min(high, r.threshold))), (r.right, (max(low, r.threshold), high))):
            c = by_id[r.tree, child]
            walk(c, path | {r.feature: (*bounds, share * c.cover / r.cover)})

    for (_, i), r in by_id.items():
        if i == 0:
            walk(r, {})
    return out


def expected(leaves: list[Leaf]) -> float:
    """The margin of a row of which nothing is known."""
    return sum(x.value * float(np.prod(x.share)) for x in leaves)


def shapley(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """A value for each row of x and each of its features."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        f, n = leaf.features, len(leaf.features)
        one = ((x[:, f] > np.asarray(leaf.low)) & (x[:, f] <= np.asarray(leaf.high))).astype(float)  # (rows, n)
        for i in range(n):
            # poly[:, k]: sum over the sets of k other features of the product of what they let through
            poly = np.zeros((len(x), n))
            poly[:, 0] = 1
            for j in range(n):
                if j != i:
                    known = poly[:, :-1] * one[:, [j]]
                    poly *= leaf.share[j]
                    poly[:, 1:] += known
            weight = np.asarray([factorial(k) * factorial(n - 1 - k) / factorial(n) for k in range(n)])
            out[:, f[i]] += leaf.value * (one[:, i] - leaf.share[i]) * (poly @ weight)
    return out


def attribute(rows: DataFrame, leaves: list[Leaf], features: Column, size: int) -> DataFrame:
    """rows with attributions, an array of one value for each of size features; a null or NaN feature is an error."""
    shared = rows.sparkSession.sparkContext.broadcast(leaves)  # as large as the model

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = b.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), size)
            if np.isnan(x).any():
                raise ValueError("a feature is missing")
            yield pa.array(list(shapley(shared.value, x)), pa.list_(pa.float64()))

    return rows.withColumn("attributions", run(features))


def summary(attributed: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean_abs and mean: how far each feature moves margins, the farthest first."""
    n = [F.get("attributions", i) for i in range(len(names))]
    one = attributed.agg(*[F.struct(F.avg(F.abs(v)).alias("mean_abs"), F.avg(v).alias("mean")).alias(f"f{i}") for i, v in enumerate(n)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"f{i}.mean_abs").alias("mean_abs"), F.col(f"f{i}.mean").alias("mean")) for i, name in enumerate(names)])).alias("x")).select("x.*").orderBy(F.desc("mean_abs"), "feature")


def of_model(model: GBTClassificationModel, path: str) -> list[Leaf]:
    """The leaves of a fitted forest, which is saved at path for its table of nodes."""
    model.write().overwrite().save(path)
    return leaf_paths(node_table(SparkSession.active(), path).collect())  # a row for each node of the model
