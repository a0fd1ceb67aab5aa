"""Incremental runs: idempotent by record key, durable by micro-batch, with snapshots.

The first arrival of a key is processed; where a log nevertheless has a key
twice, its last record counts when it is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from pairlens.operators.matching import last_records, remaining


def run_once(todo: DataFrame, work: Callable[[DataFrame], DataFrame], log: str, key: str = "record_key") -> int:
    """Batch form: what the log lacks is worked on and appended; returns how many rows that was."""
    spark = todo.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    left = remaining(todo, spark.read.parquet(log), key) if there else todo
    left = left.dropDuplicates([key]).cache()
    n = left.count()
    if n:
        work(left).write.mode("append").parquet(log)
    left.unpersist()
    return n


def stream(todo: DataFrame, work: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, key: str = "record_key", snapshot: Callable[[DataFrame, int], None] | None = None, every: int = 10) -> StreamingQuery:
    """Streaming form: each key once, micro-batches appended to the log, and snapshot() called every so many of them.

    The state that drops repeats grows with the keys; give todo a watermark and
    use dropDuplicatesWithinWatermark upstream where repeats come close together.
    """
    def batch(df: DataFrame, number: int) -> None:
        run_once(df, work, log, key)
        if snapshot and number % every == 0:
            snapshot(df.sparkSession.read.parquet(log), number)

    return todo.dropDuplicates([key]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, log: str, key: str = "record_key", ordinal: str = "ordinal") -> DataFrame:
    return last_records(spark.read.parquet(log), key, ordinal).select("record.*")


class Progress(StreamingQueryListener):
    """Tells how far a query came, every so many rows."""

    def __init__(self, tell: Callable[[int], None], every: int = 1000):
        self.tell, self.every, self.rows, self.told = tell, every, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if self.rows - self.told >= self.every:
            self.told = self.rows
            self.tell(self.rows)

    def onQueryTerminated(self, event) -> None:
        self.tell(self.rows)
