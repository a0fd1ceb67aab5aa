"""A feature matrix that grows: rows are known by what they hold, and only unknown ones are computed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.sources import storage
from pairlens.streaming.measured import write_measured


def content_key(inputs: list[str], version: str) -> Column:
    """A digest of the inputs, nulls and empty texts told apart, and of the version of what is computed from them."""
    fields = F.to_json(F.struct(F.lit(version).alias("version"), *[F.col(c).alias(c) for c in inputs]), {"ignoreNullFields": "false"})
    return F.sha2(fields, 256)


class FeatureMatrix:
    """Features by content key in folder, an update a part; parts are published one by one, so a failed update leaves nothing behind.

    compute: takes content_key and the inputs, gives content_key and the features, a row each.
    """

    def __init__(self, spark: SparkSession, folder: str, inputs: list[str], features: list[str], compute: Callable[[DataFrame], DataFrame], version: str = "1"):
        self.spark, self.folder, self.inputs, self.features, self.compute, self.version = spark, folder, inputs, features, compute, version

    def parts(self) -> list[str]:
        return (storage.current(self.spark, self.folder) or {}).get("parts", [])

    def table(self) -> DataFrame | None:
        """content_key and features of everything computed so far."""
        parts = self.parts()
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts]) if parts else None

    def update(self, rows: DataFrame) -> int:
        """Computes what rows hold and the matrix lacks, once for rows alike; returns how many that were."""
        keyed = rows.select(content_key(self.inputs, self.version).alias("content_key"), *self.inputs)
        known = self.table()
        if known is not None:
            keyed = keyed.join(known.select("content_key"), "content_key", "left_anti")
        todo = keyed.dropDuplicates(["content_key"])
        part = f"part-{uuid.uuid4().hex}"
        n = write_measured(self.compute(todo).select("content_key", *self.features), f"{self.folder}/{part}")["n_rows"]
        if n:
            storage.publish(self.spark, self.folder, part, {"parts": [*self.parts(), part]})
        else:
            storage.Files(self.spark, f"{self.folder}/{part}").delete()
        return n

    def matrix(self, rows: DataFrame, label: str = "label", keep: tuple[str, ...] = ("sample_id",)) -> DataFrame:
        """keep, label, y (1: match) and the features of rows; a row without either label is an error that names it, as is one without features."""
        first = F.coalesce(F.col(keep[0]).cast("string"), F.lit("null"))
        y = F.when(F.col(label) == "match", 1).when(F.col(label) == "mismatch", 0).otherwise(F.raise_error(F.concat(F.lit("a row has no label: "), first)).cast("int"))
        keyed = rows.select(*keep, F.col(label).alias("label"), y.alias("y"), content_key(self.inputs, self.version).alias("content_key"))
        known = self.table()
        if known is None:
            raise ValueError("the matrix is empty; update it first")
        out = keyed.join(known.withColumn("there", F.lit(True)), "content_key", "left")
        there = F.when(F.col("there"), F.col("y")).otherwise(F.raise_error(F.concat(F.lit("a row has no features: "), first)).cast("int"))
        return out.select(*keep, "label", there.alias("y"), *self.features)
