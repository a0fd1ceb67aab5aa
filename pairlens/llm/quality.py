"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once and keeps the measurements with one bit
for each rule that a document fails.  A policy is a named, versioned set of
rules; ``apply_policy`` and ``ablations`` need the ledger alone, never the
texts again.

Nulls and edge cases: a null text counts as a text without words; texts are
taken whole; repeated rows get equal rows; a null doc_id stays null; an empty
table gives an empty ledger; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import ids_and_text, tidy

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: A word of two characters or more that has one of the first and none of the second is shouted.
CAPITALS, SMALL = re.compile(b"[A-Z]"), re.compile(b"[a-z]")

#: What fails, by measurements: numbers of one text, or columns of a ledger.  The bit of a rule is its place in this list: rules are only ever appended.
RULES: list[tuple[str, Callable]] = [
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    ("shouting", lambda m: 2 * m["n_shouted"] > m["n_words"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 25 * m["n_words"]),
]


@dataclass(frozen=True)
class Policy:
    """The rules that reject, by name; a change of the set is a new version."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        places = {name: i for i, (name, _) in enumerate(RULES)}
        return sum(1 << places[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
#: Repeated lines are measured but do not reject: removing them is line dedup's task.
STRICT = Policy("prose", 1, ("few_words", "repeated_windows", "symbols", "shouting", "short_words", "long_words"))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that are equal where the pairs (a, b) are."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words within windows of WINDOW words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) < 4096:  # five ids of 12 bits are one exact number
        k = ids[:n]
        for j in range(1, WINDOW):
            k = (k << 12) | ids[j : j + n]
    else:
        k = ids[:n]
        for j in range(1, WINDOW):
            k = _pairs(k, ids[j : j + n])
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    chars = int(((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80).sum())
    seen: set[bytes] = set()
    dup = full = 0
    for line in text.split(b"\n"):
        if line.strip():
            full += 1
            dup += line in seen
            seen.add(line)
    shouted = 0 if not CAPITALS.search(text) else sum(1 for w in words if CAPITALS.search(w) and not SMALL.search(w) and len(w.decode("utf-8", "replace")) > 1)
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), dup, repeated_words(words), full, shouted


def measurements(docs: DataFrame) -> DataFrame:
    """A row of measurements for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", *MEASURES])

    return ids_and_text(docs).mapInArrow(run, SCHEMA)


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements, and failed: a bit for each rule that the document fails."""
    bits = F.lit(0).cast("long")
    measured = {m: F.col(m) for m in MEASURES}
    for i, (_, failing) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failing(measured), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs).withColumn("failed", bits)


def apply_policy(table: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger with kept, and which version of which policy decided."""
    return table.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0).withColumn("policy", F.lit(f"{policy.name}-v{policy.version}"))


def ablations(table: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects."""
    sets = table.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).count()
    names = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if name in policy.rules]
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in names])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return sets.select("bits", "count", one).groupBy(F.col("r.rule").alias("rule")).agg(F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count"))), F.lit(0)).alias("n_only"))


def kept_documents(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The documents that the policy keeps, with the columns they came with.

    The decision is made where the text is read: no shuffle and no join.
    """
    keep_bits = policy.mask
    names = list(MEASURES)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.filter(pa.array([not (failed_bits(dict(zip(names, measure(t), strict=True))) & keep_bits) for t in b.column(i).cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), schema)


def failed_bits(m: dict[str, int]) -> int:
    """RULES over the measurements of one text."""
    return sum(1 << i for i, (_, failing) in enumerate(RULES) if failing(m))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    table = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed", "policy")


OP7_SQL = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
i AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS k, lead(x, 4) OVER o IS NOT NULL AS whole FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM i WHERE whole),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM k WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND length(x) > 1)) AS n_shouted
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
  + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END + CASE WHEN 2 * n_shouted > n_words THEN 16 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & (1 + 2 + 4 + 16 + 32 + 64) = 0 AS kept, failed, 'prose-v1' AS policy FROM f
"""
