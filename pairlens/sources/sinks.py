"""Sinks: JSON lines, feature tables, predictions, sidecar updates, reports and manifests."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str) -> None:
    """Adds records; Spark's commit makes them appear together."""
    rows.write.mode("append").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(value: object, path: str) -> None:
    """A report of the driver's, as JSON with sorted keys, under its name only when it is whole."""
    part = f"{path}.tmp"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def write_features(rows: DataFrame, path: str, names: list[str]) -> None:
    rows.select("sample_id", "split", "label", "label_id", *names).write.mode("overwrite").option("header", True).csv(path)


def prediction_rows(rows: DataFrame, probabilities: list[str], features: list[str]) -> DataFrame:
    """rows with probs as a struct and features as a map."""
    entries = [x for f in features for x in (F.lit(f), F.col(f).cast("double"))]
    return rows.withColumn("probs", F.struct(*probabilities)).withColumn("features", F.create_map(*entries)).drop(*probabilities, *features)


def write_predictions(rows: DataFrame, metrics: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(f"{path}/predictions")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def patched(sidecars: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A new version of sidecars with the fields of updates; updates of records that aren't there add nothing."""
    side = updates.select(key, *[F.col(f).alias(f"__u_{f}") for f in fields])
    return sidecars.join(side, key, "left").withColumns({f: F.coalesce(f"__u_{f}", f) for f in fields}).drop(*[f"__u_{f}" for f in fields])


def failed_record(gold: Column, sample_id: Column, objects: Column, lies: Column) -> Column:
    """gold of a record that was corrupted for these reasons."""
    return gold.withField("is_corrupted", F.lit(True)).withField("from_summary_fixed", F.lit(True)).withField("objects", objects).withField("lies", lies).withField("lie", F.array_join(lies, "; "))


def clean_record(gold: Column) -> Column:
    return gold.withField("is_corrupted", F.lit(False)).dropFields("lies", "objects", "lie")


def copies(rows: DataFrame, source: str, target: str, suffixes: list[str]) -> DataFrame:
    """A manifest of files to copy, a row each: files are moved by other means."""
    swap = lambda c, s: F.regexp_replace(c, r"\.[^./]*$", f".{s}")
    each = F.explode(F.array(*[F.struct(swap(source, s).alias("from"), swap(target, s).alias("to")) for s in suffixes])).alias("c")
    return rows.select(each).select("c.from", "c.to")


def append_metrics(metrics: DataFrame, path: str, run: str) -> None:
    metrics.withColumn("run", F.lit(run)).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
