"""Near-duplicate embeddings by one navigable small-world graph per shard.

Equal vectors are one from the start, however many there are.  The distinct
ones are dealt over shards, each shard is indexed whole, and its beam is
widened until an audit against brute force passes.  Every vector queries every
shard.  Pairs are verified by their cosine in double precision and linked into
components; what leaves a task is counts and a spanning forest of its links.

Nulls and edge cases: vectors that are null, empty, zero or hold null or
non-finite components link with nothing, not even with their like; vectors of
different lengths do not link; a null vec_id takes part in links but names no
component (its own is null if no other id is reached) and is never kept;
repeated rows are vectors of their own that link with each other; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import Tables, components, keyed_join, new_path
from pairlens.llm.hnsw import Graph
from pairlens.llm.simhash import forest
from pairlens.llm.warc import open_fs

LEAST = 0.95
#: Vectors in a shard at most, and shards at least.
SHARD_ROWS, SHARDS = 65_536, 8
#: Bytes of a shard's vectors, at most.
SHARD_BYTES = 100_000_000
#: Share of pairs that the audit asks for, and with how many vectors it asks, on average.
AUDIT, AUDITED = 0.98, 256
#: Single precision may be off by so much; double precision decides.
SLACK = 1e-4


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay in range
    x = x / np.where(big > 0, big, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(vectors: DataFrame, queries: np.ndarray, own: np.ndarray, folder: str, size: int, least: float) -> DataFrame:
    """vectors: uid, n, shard, v.  Writes a graph for each shard, its beam widened by an audit with queries of all shards; returns file names and audited recalls."""
    asked = vectors.sparkSession.sparkContext.broadcast((queries, own))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = _unit(_matrix(table["v"].combine_chunks(), size))
        g = Graph.build(x, table["uid"].to_numpy(), exact=x, copies=table["n"].to_numpy())
        pairs, neighbours = g.audit(least, AUDIT, *asked.value)
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
            f.write(g.dump())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "file": [name], "recall": [pairs], "neighbours": [neighbours], "beam": pa.array([g.ef], pa.int32())})

    return vectors.groupBy("shard").applyInArrow(run, "shard int, file string, recall double, neighbours double, beam int")


def _audit_queries(part: DataFrame, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """About AUDITED vectors of all shards, chosen by hash, and their uids: the same for every shard."""
    rows = part.where(F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(max(n, 1))) < AUDITED).select("uid", "v").collect()
    return _unit(np.asarray([r.v for r in rows], np.float64).reshape(-1, size)), np.asarray([r.uid for r in rows], np.int64)


def near_duplicates(table: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vec_id and embedding."""
    spark = table.sparkSession
    t = Tables(spark)
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, v).alias("v"))
    own = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    own = t.write(own.withColumn("uid", F.monotonically_increasing_id()).withColumn("size", F.size("v")), "vectors")
    edges = None
    tasks = max(SHARDS, spark.sparkContext.defaultParallelism)
    for size in [r.size for r in own.select("size").distinct().collect()]:  # one, in tables that hold one kind of vector
        part = own.where(F.col("size") == size)
        n = part.count()
        most = max(1, min(SHARD_ROWS, SHARD_BYTES // (size * 12)))  # single and double precision
        shards = max(SHARDS, -(-n // most))
        folder = new_path(spark, "graphs")
        done = t.write(_index(part.select("uid", "n", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), "v"), *_audit_queries(part, n, size), folder, size, least), "graphs")
        if (worst := done.agg(F.min("recall")).first()[0]) is not None and worst < AUDIT:  # the beam is as wide as the shard: an error in the graph
            raise RuntimeError(f"an audited shard finds {worst:.4f} of its pairs")

        files = [r.file for r in done.select("file").collect()]  # a name for each shard
        found = t.write(_links(part.select("uid", "n", "v").repartition(max(tasks, -(-n // most))), folder, files, size, least), "links")
        edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = edges.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    roots = t.write(components(spark, edges.where("b is not null").select("a", "b")), "roots")
    named = own.drop("size").join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").join(counts, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    named = t.write(named.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1), "named")
    least_id = named.groupBy("root").agg(F.min("first").alias("component_id"))
    final = t.write(named.join(least_id, "root").select("v", "n", "n_links", "component_id"), "final")
    out = keyed_join(rows, final, "v", rows.count(), spread=F.xxhash64("vec_id"))
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _links(vectors: DataFrame, folder: str, files: list[str], size: int, least: float) -> DataFrame:
    """vectors: uid, n, v.  A forest of the links as (a, b), and rows (a, null, links): how many rows a links with in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, parts = [], []
        for b in batches:
            uid.append(b.column("uid").to_numpy())
            parts.append(_matrix(b.column("v"), size))
        if not uid:
            return
        ids, x = np.concatenate(uid), _unit(np.concatenate(parts))
        q = x.astype(np.float32)
        fs, root = open_fs(folder)
        for name in files:
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                g = Graph.load(f.read())
            row, node = g.within(q, least - SLACK)
            row, node = row[ids[row] != g.ids[node]], node[ids[row] != g.ids[node]]
            exact = np.concatenate([np.einsum("id,id->i", x[row[a : a + 65536]], g.exact[node[a : a + 65536]]) for a in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
            row, node = row[exact >= least], node[exact >= least]
            a, b = forest(ids[row], g.ids[node]) if len(row) else (ids[:0], ids[:0])
            each, where = np.unique(row, return_inverse=True)
            links = np.bincount(where, weights=g.copies[node], minlength=len(each)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, ids[each]])), pa.array([*b.tolist(), *[None] * len(each)], pa.int64()), pa.array([*[None] * len(a), *links.tolist()], pa.int64())], names=["a", "b", "links"])

    return vectors.mapInArrow(run, "a long, b long, links long")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
