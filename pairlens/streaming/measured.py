"""Runs that measure themselves: counts come from the pass that writes the rows, snapshots appear whole."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from pairlens.sources import storage


def due(done: int, total: int, every_rows: int, every_percent: float, told_bucket: int) -> tuple[bool, int]:
    """Whether progress is worth telling at done of total, and the percent bucket that has been told of then.

    It is at the end, at multiples of every_rows, and whenever a new bucket of every_percent begins.
    """
    if done >= total:
        return True, 100
    bucket = int(100.0 * done / max(total, 1) // max(every_percent, 1e-6))
    new = bucket > told_bucket
    return new or (every_rows > 0 and done % every_rows == 0), bucket if new else told_bucket


def measures(ok: Column | None = None, **more: Column) -> dict[str, Column]:
    """n, n_ok (rows where ok is true) and aggregates of one's own."""
    return {"n": F.count(F.lit(1)), "n_ok": F.count_if(F.coalesce(ok, F.lit(False))) if ok is not None else F.count(F.lit(1))} | more


def _finish(seen: dict, seconds: float, total: int | None) -> dict:
    n = seen["n"]
    out = {k: v for k, v in seen.items() if k not in ("n", "n_ok")}
    out |= {"n_rows": n, "n_ok": seen["n_ok"], "ok_rate": seen["n_ok"] / n if n else 0.0, "elapsed_sec": round(seconds, 3), "rows_per_sec": round(n / max(seconds, 1e-6), 3)}
    return out | ({"percent": round(100.0 * n / max(total, 1), 3)} if total is not None else {})


def write_measured(rows: DataFrame, path: str, ok: Column | None = None, total: int | None = None, mode: str = "overwrite", **more: Column) -> dict:
    """Writes rows as Parquet and returns n_rows, n_ok, ok_rate, seconds, throughput, percent of total, and more, all from that one pass."""
    seen = Observation(f"measured-{uuid.uuid4().hex}")
    began = time.monotonic()
    rows.observe(seen, *[c.alias(k) for k, c in measures(ok, **more).items()]).write.mode(mode).parquet(path)
    return _finish(seen.get, time.monotonic() - began, total)


def write_feature_table(rows: DataFrame, folder: str, names: list[str], about: dict | None = None, label: str = "label") -> dict:
    """A new version of a feature table, published with its meta data when it is whole; an earlier version can be read until then.

    The meta data: rows, features and their names, rows of either label, seconds, throughput, and about.
    """
    version = f"v-{uuid.uuid4().hex}"
    counts = {"n_match": F.count_if(F.col(label) == "match"), "n_mismatch": F.count_if(F.col(label) == "mismatch")}
    missing = F.lit(False)
    for c in names:
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    info = write_measured(rows, f"{folder}/{version}", ok=~missing, **counts)
    info |= {"n_features": len(names), "feature_names": names} | (about or {})
    storage.publish(rows.sparkSession, folder, version, info)
    return info


def read_feature_table(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The published version and its meta data."""
    now = storage.current(spark, folder)
    if now is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/{now['version']}"), now


class Progress(StreamingQueryListener):
    """Tells how far streams came: rows, ok rate and percent of total, from what their batches observed under name.

    Each batch ends with one observation, so nothing is counted twice or read again.
    """

    def __init__(self, tell: Callable[[dict], None], name: str, total: int, every_rows: int = 0, every_percent: float = 5.0):
        self.tell, self.name, self.total = tell, name, total
        self.every_rows, self.every_percent = every_rows, every_percent
        self.n = self.n_ok = 0
        self.bucket, self.began = -1, time.monotonic()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None or not row["n"]:
            return
        before = self.n
        self.n, self.n_ok = self.n + row["n"], self.n_ok + row["n_ok"]
        # a batch may step over a multiple
        passed = self.every_rows > 0 and self.n // self.every_rows > before // self.every_rows
        told, self.bucket = due(self.n, self.total, 0, self.every_percent, self.bucket)
        if told or passed:
            self.tell(_finish({"n": self.n, "n_ok": self.n_ok}, time.monotonic() - self.began, self.total))

    def onQueryTerminated(self, event) -> None:
        pass
