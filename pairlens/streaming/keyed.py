"""Keyed state for resumable runs: what has been seen is state of the stream, not a log that is read again.

A key's state is the ordinal of its last record; records that are not later are
late repeats and go no further.  State expires by its time to live, so it does
not grow with the keys that ever were.  Micro-batches are written to folders of
their own number, so that one which runs again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pairlens.operators.matching import last_records

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Batches without data, which a time to live asks for without end.
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastRecord(StatefulProcessor):
    """Of each key, the last record of a batch if it is later than all before; first_only: only a key's first record ever.

    __first says whether the key is new.
    """

    def __init__(self, ordinal: str, ttl_ms: int | None, first_only: bool):
        self.ordinal, self.ttl_ms, self.first_only = ordinal, ttl_ms, first_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("ordinal", T.LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            at = pdf[self.ordinal].idxmin() if self.first_only else pdf[self.ordinal].idxmax()
            row = pdf.loc[[at]]
            if best is None or (row[self.ordinal].iloc[0] < best[self.ordinal].iloc[0]) == self.first_only:
                best = row
        seen = self.last.exists()
        if best is None or (seen and (self.first_only or best[self.ordinal].iloc[0] <= self.last.get()[0])):
            return
        self.last.update((int(best[self.ordinal].iloc[0]),))
        yield best.assign(__first=not seen)

    def close(self) -> None:
        pass


def latest(todo: DataFrame, key: str = "record_key", ordinal: str = "ordinal", ttl_ms: int | None = None, first_only: bool = False) -> DataFrame:
    """todo, a stream, without repeats and late records, and with __first; start it with start()."""
    schema = T.StructType([*todo.schema.fields, T.StructField("__first", T.BooleanType())])
    processor = LastRecord(ordinal, ttl_ms, first_only)
    return todo.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def start(rows: DataFrame, log: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """work on each micro-batch of what latest() gives, into the folder of its number; all that is there, then the end."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{log}/batch={number}")

    spark = rows.sparkSession
    own = {PROVIDER: ROCKSDB, IDLE: "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():  # the query takes its settings when it starts
        spark.conf.set(k, v)
    try:
        return rows.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_log(spark: SparkSession, log: str, key: str = "record_key", ordinal: str = "ordinal") -> DataFrame:
    """The last record of each key: over batches, where a key may have later ones."""
    return last_records(spark.read.parquet(log), key, ordinal).select("record.*").drop("batch")


def state_rows(query: StreamingQuery) -> int | None:
    """Keys in the state after the last batch that ran."""
    for p in reversed(query.recentProgress):
        for op in p.stateOperators:
            return op.numRowsTotal
    return None
