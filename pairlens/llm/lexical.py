"""Ranked lexical search over a bit-sliced impact index.

The index is kept by blocks of documents, as they lie in the tasks that read
them: nothing is shuffled by term, so frequent terms are no hot spots.  Within
a block each term has its documents, as a bitmap or a list of places, whichever
is smaller, and one bitmap for each bit of their impacts, over these documents.
An impact is the whole number that the term adds to a document's score.

A query's scores in a block are found for all its queries together: the slices
of a term are spread over the block's documents and added to the queries'
slices by carry arithmetic, one bitwise addition for each bit.  The k highest
scores are then found from the most significant slice down (documents that
stay in the race, and documents that are surely in); equal scores are taken by
ascending id.  A window over the blocks' k best ends the search.

The index covers every document, for the terms that are asked for; terms of no
query are counted but not sliced.

Nulls and edge cases: a null or empty text has no term and is no document of
the collection; whole texts are read; repeated rows are documents of their own,
and so are rows of one doc_id; a null doc_id comes after all others; a query
without terms, or whose terms no document has, gives no rows; an empty table
gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import Tables, tidy

#: Documents and postings of a block at most (one document may have more postings), queries that meet a block at once.
BLOCK, POSTINGS, QUERIES = 4096, 1 << 20, 256
#: Queries that are added up together.
TOGETHER = 64
#: Every byte of a separator is a space, A-Z are a-z; bytes of other characters stay.
_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
LAST_ID = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


def count_terms(docs: DataFrame) -> DataFrame:
    """Blocks of documents: doc_ids (by ascending id) and their n, terms, and each term's documents (places) and occurrences, one term after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        ids, n, doc, term, tf, names = [], [], [], [], [], {}

        def block() -> pa.RecordBatch:
            nonlocal number
            key = np.asarray([LAST_ID if i is None else i for i in ids], np.int64)
            order = np.lexsort((np.asarray([i is None for i in ids]), key))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            d, w, c = place[np.repeat(np.arange(len(ids)), doc)], np.asarray(term, np.int64), np.asarray(tf, np.int64)
            by_term = np.lexsort((d, w))
            df = np.bincount(w, minlength=len(names))
            out = pa.RecordBatch.from_pydict({
                "block": pa.array([task + number], pa.int64()), "doc_ids": pa.array([[ids[k] for k in order]], pa.list_(pa.int64())), "n": pa.array([np.asarray(n, np.int64)[order]]), "terms": pa.array([list(names)], pa.list_(pa.binary())),
                "df": pa.array([df.astype(np.int32)]), "docs": pa.array([d[by_term].astype(np.int32)]), "tf": pa.array([c[by_term].astype(np.int32)]),
            })
            number += 1
            for x in (ids, n, doc, term, tf, names):
                x.clear()
            return out

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                words = terms_of(text.as_py())
                if not words:
                    continue
                counts: dict[bytes, int] = {}
                for x in words:
                    counts[x] = counts.get(x, 0) + 1
                if ids and (len(ids) >= BLOCK or len(term) + len(counts) > POSTINGS):
                    yield block()
                ids.append(i)
                n.append(len(words))
                doc.append(len(counts))
                term.extend([names.setdefault(x, len(names)) for x in counts])
                tf.extend(counts.values())
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "block long, doc_ids array<long>, n array<long>, terms array<binary>, df array<int>, docs array<int>, tf array<int>")


def query_terms(queries: DataFrame, query_id: Column, text: Column) -> DataFrame:
    """item_id, qkey (the row's own number), term and how often the query has it."""
    rows = queries.select(query_id.alias("item_id"), text.cast("string").cast("binary").alias("text")).withColumn("qkey", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms_of(t) for t in b.column("text").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(rows)), b.column("qkey").take(pa.array(rows)), pa.array([t for x in found for t in x], pa.binary())], names=["item_id", "qkey", "term"])

    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, qkey long, term binary").groupBy("item_id", "qkey", "term").agg(F.count("*").alias("times"))


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, before the term's weight, in whole numbers."""
    m = 100 - 25 + (25 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def slices(values: np.ndarray) -> bytes:
    """Bitmaps of the values' bits, the least significant first, each over all values."""
    bits = int(values.max()).bit_length()
    return np.packbits((values[None, :] >> np.arange(bits)[:, None]) & 1, axis=1).tobytes()


def places(at: np.ndarray, size: int) -> bytes:
    """The documents of a term: a bitmap over size documents, or their places where that is smaller."""
    if 2 * len(at) >= (size + 7) // 8:
        has = np.zeros(size, np.uint8)
        has[at] = 1
        return np.packbits(has).tobytes()
    return at.astype("<u2").tobytes()


def spread(where: bytes, bits: bytes, count: int, size: int) -> np.ndarray:
    """A term's slices over all of the block's documents: rows of 64-bit words, one for each bit."""
    if 2 * count >= (size + 7) // 8:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(where, np.uint8), count=size))
    else:
        at = np.frombuffer(where, "<u2")
    packed = np.frombuffer(bits, np.uint8).reshape(-1, (count + 7) // 8)
    out = np.zeros((len(packed), -(-size // 64) * 64), np.uint8)
    out[:, at] = np.unpackbits(packed, axis=1, count=count)
    return np.packbits(out, axis=1).view(np.uint64)


def add(total: np.ndarray, more: np.ndarray) -> None:
    """total += more, both as slices: (queries, bits, words); total has room for the sum."""
    carry = np.zeros_like(total[:, 0])
    for b in range(more.shape[1]):
        s, x = total[:, b], more[:, b]
        half = s ^ x
        both = s & x
        np.bitwise_xor(half, carry, out=total[:, b])
        carry = both | (half & carry)
    for b in range(more.shape[1], total.shape[1]):
        if not carry.any():
            break
        s = total[:, b].copy()
        np.bitwise_xor(s, carry, out=total[:, b])
        carry &= s


def top(total: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its k highest sums above zero; equal ones by place."""
    count = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)
    race = np.bitwise_or.reduce(total, axis=1)
    sure = np.zeros_like(race)
    for b in range(total.shape[1] - 1, -1, -1):
        has = race & total[:, b]
        n = count(sure) + count(has)
        enough = (n >= k)[:, None]
        sure = np.where(enough, sure, sure | has)
        race = np.where(enough, has, race & ~has)
    out = []
    shifts = np.arange(total.shape[1], dtype=np.int64)
    for q in range(len(total)):
        first = np.flatnonzero(np.unpackbits(sure[q].view(np.uint8)))
        tied = np.flatnonzero(np.unpackbits(race[q].view(np.uint8)))[: max(0, k - len(first))]
        at = np.sort(np.concatenate([first, tied]))
        bits = (total[q].view(np.uint8).reshape(total.shape[1], -1)[:, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        out.append((at, (bits.astype(np.int64) << shifts[:, None]).sum(0)))
    return out


class Index:
    """Written tables: counts (blocks of documents), and sliced, the bitmaps of each block's asked terms."""

    def __init__(self, docs: DataFrame, asked: DataFrame):
        """asked: the terms to slice, one a row in ``term``."""
        self.t = Tables(docs.sparkSession)
        self.blocks = self.t.write(count_terms(docs), "blocks", large=True)
        has = self.blocks.agg(F.sum(F.size("doc_ids")).alias("n"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")).first()
        self.n, self.total = has.n or 0, has.total or 0
        if not self.n:
            return
        held = self.blocks.select("block", F.posexplode(F.arrays_zip("terms", "df"))).select("block", F.col("pos").alias("place"), F.col("col.terms").alias("term"), F.col("col.df").alias("df"))
        held = self.t.write(held.join(asked.select("term").distinct(), "term", "left_semi"), "held")
        self.weights = held.groupBy("term").agg(F.floor(1000 * F.log((2 * self.n + 2) / (2 * F.sum("df") + 1))).alias("w"))
        self.sliced = self.t.write(self._slice(held.join(self.weights, "term").where("w > 0").select("block", "place", "w")), "sliced")
        self.t.drop(held)

    def _slice(self, weighted: DataFrame) -> DataFrame:
        docs, total = self.n, self.total

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows: list[tuple] = []
            if len(left) and len(right):
                b = left.slice(0, 1).combine_chunks()
                one = lambda c: b[c].chunk(0).flatten()
                n, df, at, tf = (one(c).to_numpy().astype(np.int64) for c in ("n", "df", "docs", "tf"))
                names, ends = one("terms"), np.cumsum([0, *df])
                value = impact(tf, n[at], docs, total)
                for place, w in zip(right["place"].to_numpy().tolist(), right["w"].to_numpy().tolist()):
                    here = slice(ends[place], ends[place + 1])
                    if (v := value[here] * w).any():
                        rows.append((names[place].as_py(), int(df[place]), places(at[here], len(n)), slices(v)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            return pa.table([pa.array([left["block"][0].as_py()] * len(rows), pa.int64()), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["block", "term", "df", "at", "bits"])

        return self.blocks.select("block", "n", "terms", "df", "docs", "tf").groupBy("block").cogroup(weighted.groupBy("block")).applyInArrow(run, "block long, term binary, df int, at binary, bits binary")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """item_id, qkey, rank, doc_id and score of each query's k best documents; queries as query_terms returns them."""
        kind = queries.schema["item_id"].dataType.simpleString()
        many, cells = queries.select("qkey").distinct().count(), self.blocks.count()
        groups = max(1, -(-many // QUERIES))
        whole = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        asking = queries.groupBy("item_id", "qkey").agg(F.collect_list(F.struct("term", "times")).alias("terms"))  # a query's own terms
        asking = asking.withColumn("g", of("qkey", groups)).withColumn("s", whole(cells))
        empty = {"term": "binary", "df": "int", "at": "binary", "bits": "binary"}
        shards = self.blocks.select("block", "doc_ids", *[F.lit(None).cast(k).alias(c) for c, k in empty.items()])
        shards = shards.unionByName(self.sliced.withColumn("doc_ids", F.lit(None).cast("array<long>"))).withColumn("s", of("block", cells)).withColumn("g", whole(groups))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            parts = []
            block = left["block"].to_numpy() if len(left) and len(right) else np.zeros(0, np.int64)
            asked = [[(x["term"], x["times"]) for x in row] for row in right["terms"].to_pylist()] if len(block) else []
            for b in np.unique(block):
                parts += best_of_block(left.take(pa.array(np.flatnonzero(block == b))), asked, k)
            q = pa.array(np.concatenate([np.full(len(ids), q) for q, ids, _ in parts]) if parts else np.zeros(0, np.int64), pa.int64())
            ids = pa.concat_arrays([ids for _, ids, _ in parts]) if parts else pa.array([], pa.int64())
            score = np.concatenate([score for _, _, score in parts]) if parts else np.zeros(0, np.int64)
            return pa.table([right["item_id"].combine_chunks().take(q), right["qkey"].combine_chunks().take(q), ids, pa.array(score, pa.int64())], names=["item_id", "qkey", "doc_id", "score"])

        best = shards.groupBy("s", "g").cogroup(asking.groupBy("s", "g")).applyInArrow(run, f"item_id {kind}, qkey long, doc_id long, score long")
        w = Window.partitionBy("qkey").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_of_block(block: pa.Table, asked: list[list[tuple[bytes, int]]], k: int) -> list[tuple[int, pa.Array, np.ndarray]]:
    """For each query (terms and how often it has them) that finds something: its number, the ids and the scores of the k best."""
    doc_ids = block["doc_ids"].combine_chunks().drop_null().flatten()
    terms = {t: i for i, t in enumerate(block["term"].to_pylist()) if t is not None}
    df, at, bits, size = block["df"].to_pylist(), block["at"], block["bits"], len(doc_ids)
    load = lambda i: spread(at[i].as_py(), bits[i].as_py(), df[i], size)
    here = {q: held for q, row in enumerate(asked) if (held := [(terms[t], n) for t, n in row if t in terms])}
    out, some = [], list(here)
    for a in range(0, len(some), TOGETHER):
        batch = some[a : a + TOGETHER]
        for q, (where, score) in zip(batch, top(added([here[q] for q in batch], load, size), k)):
            out.append((q, doc_ids.take(pa.array(where)), score))
    return out


def added(asked: list[list[tuple[int, int]]], load, size: int) -> np.ndarray:
    """The slices of the queries' scores: for each query, the sum of its terms' slices, as often as it has them.

    asked: for each query (term, times); load(term): its slices over the block.
    """
    words = -(-size // 64)
    kept: dict[int, np.ndarray] = {}
    widest = 0
    for row in asked:
        for term, times in row:
            if term not in kept:
                kept[term] = load(term)
            widest = max(widest, len(kept[term]) + times.bit_length())
    longest = max(sum(t.bit_count() for _, t in row) for row in asked)
    total = np.zeros((len(asked), widest + longest.bit_length() + 1, words), np.uint64)
    # times as shifts: a term that a query has five times is added at once and two places higher
    steps = [[(term, shift) for term, times in row for shift in range(times.bit_length()) if times >> shift & 1] for row in asked]
    for j in range(longest):
        rows = [q for q, x in enumerate(steps) if j < len(x)]
        deep = max(len(kept[steps[q][j][0]]) + steps[q][j][1] for q in rows)
        more = np.zeros((len(rows), deep, words), np.uint64)
        for r, q in enumerate(rows):
            term, shift = steps[q][j]
            more[r, shift : shift + len(kept[term])] = kept[term]
        part = total[rows]
        add(part, more)
        total[rows] = part
    return total


def rank(docs: DataFrame, queries: DataFrame, query_id: Column, text: Column, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score: each query's k best documents."""
    asked = Tables(docs.sparkSession).write(query_terms(queries, query_id, text), "asked")
    index = Index(docs, asked)
    if not index.n:
        return docs.sparkSession.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return index.search(asked, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), F.col("item_id"), F.col("text"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL
), docs AS (SELECT d, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0
), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs
), i AS (SELECT row_number() OVER () AS k, item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark
), q AS (SELECT * FROM (SELECT row_number() OVER () AS k, item_id, text FROM benchmark)
), asked AS (SELECT k, item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest({_TERMS.format("text")}) AS term FROM q) GROUP BY ALL
), p AS (
  SELECT d, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY d, term
), w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term
), s AS (
  SELECT k, any_value(item_id) AS item_id, d, any_value(doc_id) AS doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN p USING (term), c GROUP BY k, d
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""
