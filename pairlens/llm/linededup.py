"""Line dedup by content-defined chunks, in DataFrame operations only.

A document's lines are hashed, a rolling hash over each line's hash and the one
before it chooses the lines that end a chunk, and so boundaries move with the
text: a line put in or taken out changes the chunks around it and no others.
A chunk with two or more lines that have words, and whose bytes also occur in
an earlier place of the corpus (smaller doc_id, or further up in the same
document), is removed; its first occurrence stays.

Chunks are grouped by hash and bytes, so equality is of bytes.  Where a hash
turns out to stand for one text only, as good as always, occurrences are then
matched by hash alone; for the others the bytes are matched as well.

Nulls and edge cases: a null text stays null and an empty one empty; a null
doc_id comes before all others; rows that are equal in doc_id and text count
as one and are treated alike; a document may lose all its text, its row stays;
an empty table gives an empty one; all columns are kept, and none but doc_id
and text are looked at (names that begin with "__" are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import WORD, Tables, keyed_join

#: A chunk has so many lines on average.
MEAN_LINES = 4
MULTIPLIER, MODULUS = 31, 1_000_003


def _with_chunks(docs: DataFrame) -> DataFrame:
    """docs with __chunks, the texts of the chunks, which joined by line feeds give the text."""
    number = lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")
    out = docs.withColumn("__lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    out = out.withColumn("__h", F.transform("__lines", number))
    # each intermediate array is used twice, so that the optimizer keeps it and does not compute it again for every element
    out = out.withColumn("__before", F.concat(F.array(F.lit(0).cast("long")), F.slice("__h", F.lit(1), F.size("__h") - 1)))
    cut: Column = F.zip_with("__before", "__h", lambda a, b: (a * MULTIPLIER + b) % MODULUS % MEAN_LINES == 0)
    out = out.withColumn("__cut", cut)
    ends = F.filter(F.transform("__cut", lambda x, i: F.when(x | (i == F.size("__lines") - 1), i)), lambda i: i.isNotNull())
    out = out.withColumn("__ends", ends)
    out = out.withColumn("__starts", F.concat(F.array(F.lit(0)), F.transform(F.slice("__ends", F.lit(1), F.size("__ends") - 1), lambda i: i + 1)))
    out = out.withColumn("__chunks", F.zip_with("__starts", "__ends", lambda s, e: F.array_join(F.slice("__lines", s + 1, e - s + 1), "\n")))
    return out


def _keys(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__k1"), F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("__k2")]


def _eligible(chunks: Column | str) -> Column:
    """(pos, chunk) for chunks that may go: two lines with a word at least."""
    full = lambda c: F.size(F.filter(F.split(c, "\n", -1), lambda x: x.rlike(WORD)))
    return F.filter(F.transform(chunks, lambda c, i: F.struct(i.alias("pos"), c.alias("chunk"))), lambda x: full(x["chunk"]) >= 2)


def removals(docs: DataFrame) -> DataFrame:
    """(__k1, __k2, __gone): for each row that loses chunks, their positions."""
    spark = docs.sparkSession
    t = Tables(spark)
    rows = _with_chunks(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(docs), F.explode(_eligible("__chunks")).alias("c"))
    rows = rows.select("doc_id", "__k1", "__k2", "c.pos", "c.chunk").withColumn("h", F.xxhash64("chunk"))
    place = F.struct("doc_id", "__k2", "pos")
    groups = rows.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    by_hash = t.write(groups.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1"), "repeated")
    once = by_hash.where("texts = 1").drop("texts")
    slim = t.write(rows.select("doc_id", "__k1", "__k2", "pos", "h"), "places")
    same = keyed_join(slim, once, "h", slim.count(), how="inner", spread=F.xxhash64("__k1", "__k2", "pos")).where(place != F.col("first")).select("__k1", "__k2", "pos")
    mixed = by_hash.where("texts > 1")
    if not mixed.isEmpty():  # one hash, several texts
        own = rows.join(mixed.select("h"), "h", "left_semi")
        firsts = own.groupBy("h", "chunk").agg(F.min(place).alias("first"))
        same = same.unionByName(own.join(firsts, ["h", "chunk"]).where(place != F.col("first")).select("__k1", "__k2", "pos"))
    out = t.write(same.groupBy("__k1", "__k2").agg(F.collect_set("pos").alias("__gone")), "removals")
    t.drop(by_hash, slim)
    return out


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs without repeated chunks; with counts, also n_lines, n_chunks, n_removed_lines and n_removed_chunks."""
    gone = removals(docs)
    keys = _keys(docs)
    joined = docs.withColumn("__k1", keys[0]).withColumn("__k2", keys[1]).join(gone, ["__k1", "__k2"], "left")
    out = _with_chunks(joined).withColumn("__left", F.when(F.col("__gone").isNull(), F.col("__chunks")).otherwise(F.filter(F.transform("__chunks", lambda c, i: F.when(~F.array_contains("__gone", i), c)), lambda c: c.isNotNull())))
    text = F.when(F.col("text").isNull() | F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join("__left", "\n"))
    cols = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        there = F.col("text").isNotNull()
        n = lambda c: F.when(there, c).otherwise(0).cast("long")
        left_lines = F.when(F.size("__left") == 0, 0).otherwise(F.size(F.split(F.array_join("__left", "\n"), "\n", -1)))
        cols += [n(F.size("__lines")).alias("n_lines"), n(F.size("__chunks")).alias("n_chunks"), n(F.size("__lines") - left_lines).alias("n_removed_lines"), n(F.size("__chunks") - F.size("__left")).alias("n_removed_chunks")]
    return out.select(*cols)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks", "text")


OP2_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS n FROM l),
b AS (SELECT *, (coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31 + n) % 1000003 % 4 = 0 AS cut FROM h),
k AS (SELECT *, coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM b),
c AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_lines, sum(CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN 1 ELSE 0 END) >= 2 AS eligible FROM k GROUP BY doc_id, pos),
r AS (SELECT *, eligible AND row_number() OVER (PARTITION BY chunk, eligible ORDER BY doc_id, pos) > 1 AS gone FROM c),
d AS (SELECT doc_id, CAST(sum(n_lines) AS BIGINT) AS n_lines, count(*) AS n_chunks,
  CAST(sum(CASE WHEN gone THEN n_lines ELSE 0 END) AS BIGINT) AS n_removed_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed_chunks,
  coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_chunks, 0) AS n_removed_chunks, d.text
FROM documents LEFT JOIN d USING (doc_id)
"""
