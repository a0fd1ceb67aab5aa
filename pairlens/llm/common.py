"""Helpers shared by the operators: shared storage, heavy keys, components.

Intermediate results that must not be computed twice, or whose lineage has to
be cut, are written as Parquet tables in the folder that the session names in
``spark.checkpoint.dir``.  Every executor sees that folder, so a lost executor
costs its running tasks and nothing else.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy if it has more than one row in so many; there are at most as many such keys.
HEAVY_ONE_IN = 8192
#: Rows that a Python worker gets at once while a table is written: rows are whole texts.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2048
#: How tables of very large rows are written.
LARGE_GROUP = 16 << 20
LARGE_ROWS = {"parquet.block.size": LARGE_GROUP, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Bytes that split words, as the contracts give them.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, which only a local master can share with its workers."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder; driver and executors need a shared one")
        path = os.path.join("/tmp/checkpoints", f"pairlens-{os.getpid()}")
        if not os.path.isdir(path):
            os.makedirs(path)
            atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table or files that nothing else uses."""
    return f"{shared_dir(spark)}/pairlens/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Written tables of one operator call; those that the result doesn't need are dropped early."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, large: bool = False) -> DataFrame:
        """df, written and read again: computed once, and with no lineage.

        large: rows of megabytes.  Parquet looks at its memory after a hundred
        rows only, and its reader holds 4096 at once, so theirs are row groups
        of LARGE_GROUP bytes, looked at after every row.
        """
        path, conf = new_path(self.spark, name), self.spark.conf
        rows = conf.get(ARROW_ROWS)
        conf.set(ARROW_ROWS, str(min(int(rows), BATCH_ROWS)))
        try:
            df.write.option("compression", "zstd").options(**LARGE_ROWS if large else {}).parquet(path)
        finally:
            conf.set(ARROW_ROWS, rows)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                delete(self.spark, path)


def tidy(run: Callable) -> Callable:
    """run, a function over Arrow batches, which at its end gives back what memory the worker holds for later tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):  # other C libraries
                    ctypes.CDLL(None).malloc_trim(0)

    return tidied


def ids_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed_join(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "left", spread: Column | None = None) -> DataFrame:
    """Joins left to right, a table with one row for each key and its count in ``n``.

    Keys with more than rows/HEAVY_ONE_IN rows, at most HEAVY_ONE_IN of them
    whatever the input, are broadcast; only the others are shuffled.  right
    should be a written table, as it is read twice.
    """
    limit = max(rows // HEAVY_ONE_IN, 1)
    heavy = right.where(F.col("n") > limit)
    light = right.where(F.col("n") <= limit)
    cols = [c for c in right.columns if c != key]
    probe = left.join(F.broadcast(heavy.select(F.col(key), *[F.col(c).alias(f"__h_{c}") for c in cols])), key, "left")
    hot = F.col("__h_n").isNotNull()
    salt = spread if spread is not None else F.monotonically_increasing_id()
    probe = probe.withColumn("__key", F.when(~hot, F.col(key))).withColumn("__salt", F.when(hot | F.col(key).isNull(), salt.cast("long")).otherwise(F.lit(-1).cast("long")))
    out = probe.join(light.select(F.col(key).alias("__key"), F.lit(-1).cast("long").alias("__salt"), *[F.col(c).alias(f"__l_{c}") for c in cols]), ["__key", "__salt"], "left")
    for c in cols:
        out = out.withColumn(c, F.when(hot, F.col(f"__h_{c}")).otherwise(F.col(f"__l_{c}")))
    out = out.drop("__key", "__salt", *[f"__h_{c}" for c in cols], *[f"__l_{c}" for c in cols])
    return out if how == "left" else out.where(F.col("n").isNotNull())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in the undirected edges (a, b); nodes of one component share a root.

    Rounds of contraction: every node hooks onto the neighbour that comes first
    in a pseudo-random order, if that comes before itself, and edges are
    renamed to the hooks, so that the number of nodes falls by a constant
    factor whatever the shape; minima are combined before the shuffle, so hubs
    are no hot spots.  The root is no particular node of its component.
    """
    t = Tables(spark)
    rank = lambda c: F.struct(F.xxhash64(F.lit(7), c).alias("r"), c.alias("v"))
    now = t.write(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not now.isEmpty():
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = t.write(both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.when(F.col("m") < rank(F.col("a")), F.col("m.v")).otherwise(F.col("a")).alias("to")), "hook")
        jump = t.write(hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("up")), "to").select("node", F.col("up").alias("to")), "jump")
        t.drop(hook)
        before = labels
        labels = t.write(jump.select("node", F.col("to").alias("root")) if labels is None else labels.join(jump.select(F.col("node").alias("root"), F.col("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        old = now
        now = t.write(old.join(jump.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(jump.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        t.drop(old, jump, before)
    t.drop(now)
    return labels if labels is not None else spark.createDataFrame([], "node long, root long")
