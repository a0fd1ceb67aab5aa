"""Temperature mixing of sources, realised as budgeted block permutations.

Source weights are token shares to a power, normalised.  The exponent is
bisected between 1 (natural shares) and 0 (all sources alike) for the entropy
that the weights should have, and again for the smallest exponent at which no
source is repeated more often than allowed; the larger of the two holds.

Each source has a token budget.  Whole passes over the source are blocks that
hold every document; the last block takes documents in a pseudo-random order
(by the MD5 of seed, block and doc_id, or text where there is no id) while they fit the rest of the budget.
The order is cut by hash prefixes first, so that only the documents of one
prefix per source are ever sorted, and the choice is one comparison of each
document's hash with its source's cut: texts are not shuffled.

Nulls and edge cases: a null source is a source of its own; a null text has no
tokens; documents without tokens are never chosen, nor is a source of such
documents; rows that are equal in source and doc_id, or without id in source and
text, are chosen together;
an empty table gives an empty one; all columns are kept, and none but doc_id,
text and source are looked at (names that begin with "__" are reserved).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import WORD, Tables, keyed_join

SEED = 17
#: Documents that share a hash prefix, on average, at most.
PREFIX_ROWS = 4096
#: Hexadecimal digits by which prefixes get longer at a time: no source has more prefixes at once than so many digits make.
LEVEL_DIGITS = 2
STEPS, HALVINGS = 40, 4


def _tokens(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _name() -> Column:
    """What a document is ordered by: its id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.md5(F.col("text").cast("string").cast("binary"))))


def _order(seed: int, block: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.col("__name")).cast("binary"))


def _at(shares: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """For each exponent, the entropy of the weights and the most repetitions of a source; one pass over the sources."""
    row = shares.agg(*[
        f.alias(f"{name}{i}")
        for i, x in enumerate(exponents)
        for name, f in (("z", F.sum(F.pow("share", F.lit(x)))), ("s", F.sum(F.pow("share", F.lit(x)) * F.lit(x) * F.log("share"))), ("m", F.max(F.pow("share", F.lit(x)) * F.lit(float(budget)) / F.col("tokens"))))
    ]).first()
    return [(math.log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"], row[f"m{i}"] / row[f"z{i}"]) for i in range(len(exponents))]


def _bisect(shares: DataFrame, budget: float, good) -> float:
    """The largest exponent in [0, 1] for which good(), true below and false above it, still holds.

    Halved STEPS times; a pass over the sources tries all the points that the next HALVINGS may need.
    """
    low, width = 0.0, 1.0
    for _ in range(STEPS // HALVINGS):
        width /= 2**HALVINGS
        tried = _at(shares, [low + width * i for i in range(1, 2**HALVINGS)], budget)
        low += width * sum(1 for x in tried if good(x))
    return low


def exponent_for(shares: DataFrame, budget: float, entropy: float | None, max_repeats: float | None) -> float:
    """shares: share and tokens of each source; entropy in nats, or halfway between natural and uniform.

    No mixture repeats its sources less than the natural one, so a limit that this one breaks can't be met: an error.
    """
    natural, most = _at(shares, [1.0], budget)[0]
    if max_repeats is not None and most > max_repeats * (1 + 1e-9):
        raise ValueError(f"a budget of {budget} tokens repeats every source {most:.3f} times or more; {max_repeats} are allowed")
    if entropy is None:
        entropy = (natural + math.log(shares.count())) / 2
    out = 1.0 if entropy <= natural else _bisect(shares, budget, lambda x: x[0] >= entropy)
    if max_repeats is not None and _at(shares, [out], budget)[0][1] > max_repeats:
        out = _bisect(shares, budget, lambda x: x[1] > max_repeats)
    return round(out, 6)


def _within(rows: DataFrame, edge: DataFrame, digits: int) -> DataFrame:
    """Rows whose order begins with the prefix, of so many digits, that edge has for their source; with before, the tokens up to there."""
    return rows.withColumn("prefix", F.substring("__order", 1, digits)).join(edge, ["__source", "prefix"]).drop("prefix")


def plan(docs: DataFrame, budget: int | None = None, entropy: float | None = None, max_repeats: float | None = 4.0, seed: int = SEED) -> DataFrame:
    """A row for each source with tokens: weight, budget, whole blocks, and the hash up to which the last block goes."""
    spark = docs.sparkSession
    t = Tables(spark)
    slim = t.write(docs.select(_source().alias("__source"), _name().alias("__name"), _tokens(docs).alias("__tokens")).where("__tokens > 0"), "tokens")
    sums = t.write(slim.groupBy("__source").agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    total, rows = sums.agg(F.sum("tokens"), F.sum("n")).first()
    empty = "__source string, tokens long, n long, weight double, budget long, blocks long, cut string"
    if not total:
        return spark.createDataFrame([], empty)
    budget = budget or total
    shares = sums.select("tokens", (F.col("tokens") / F.lit(total)).alias("share")).cache()
    x = exponent_for(shares, budget, entropy, max_repeats)
    norm = shares.agg(F.sum(F.pow("share", F.lit(x)))).first()[0]
    shares.unpersist()
    weight = F.round(F.pow(F.col("tokens") / F.lit(total), F.lit(x)) / F.lit(norm), 9)
    params = sums.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * F.lit(budget)).cast("long"))
    params = t.write(params.withColumn("blocks", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("rest", F.col("budget") - F.col("blocks") * F.col("tokens")), "params")
    hashed = keyed_join(slim, params.select("__source", "n", "blocks", "rest"), "__source", rows, how="inner").withColumn("__order", _order(seed, F.col("blocks")))
    hashed = t.write(hashed.select("__source", "__tokens", "rest", "__order"), "hashed")
    levels = max(1, math.ceil(math.log(max(rows / PREFIX_ROWS, 1), 16**LEVEL_DIGITS)))
    own, edges = hashed.withColumn("before", F.lit(0).cast("long")), []
    for digits in range(LEVEL_DIGITS, LEVEL_DIGITS * levels + 1, LEVEL_DIGITS):  # longer prefixes, within the one that the cut is in
        by_prefix = own.groupBy("__source", F.substring("__order", 1, digits).alias("prefix")).agg(F.sum("__tokens").alias("sum"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("sum").over(Window.partitionBy("__source").orderBy("prefix"))
        first = by_prefix.withColumn("upto", upto).where("upto > rest").groupBy("__source").agg(F.min(F.struct("prefix", (F.col("upto") - F.col("sum")).alias("before"))).alias("e"))
        edges.append(edge := t.write(first.select("__source", "e.prefix", "e.before"), "edges"))
        own = _within(hashed, edge, digits)
    within = own.withColumn("upto", F.col("before") + F.sum("__tokens").over(Window.partitionBy("__source").orderBy("__order")))
    cut = within.where("upto <= rest").groupBy("__source").agg(F.max("__order").alias("last"))
    out = params.join(edge, "__source", "left").join(cut, "__source", "left")
    out = t.write(out.select("__source", "tokens", "n", "weight", "budget", "blocks", F.coalesce("last", "prefix").alias("cut")), "plan")
    t.drop(slim, sums, params, hashed, *edges)
    return out


def choose(docs: DataFrame, seed: int = SEED, **target) -> DataFrame:
    """docs with __tokens, __weight and __copies, how often each is used; target as for plan."""
    params = plan(docs, seed=seed, **target)
    base = docs.withColumns({"__source": _source(), "__tokens": _tokens(docs), "__name": _name()})
    n = params.agg(F.sum("n")).first()[0] or 0
    own = keyed_join(base, params.select("__source", "n", "weight", "blocks", "cut"), "__source", n, spread=F.xxhash64("doc_id"))
    last = (_order(seed, F.col("blocks")) <= F.col("cut")).cast("long")
    copies = F.when((F.col("__tokens") > 0) & F.col("blocks").isNotNull(), F.col("blocks") + last).otherwise(0).cast("long")
    return own.select(*[F.col(f"`{c}`") for c in docs.columns], "__tokens", F.coalesce("weight", F.lit(0.0)).alias("__weight"), copies.alias("__copies"))


def mix(docs: DataFrame, seed: int = SEED, **target) -> DataFrame:
    """docs as the mixture has them: each document as often as it was chosen."""
    out = choose(docs, seed, **target).where("__copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1, __copies)")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return choose(docs).select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__copies").alias("copies"))


OP8_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, source, text, coalesce(source, chr(0)) AS s, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
q AS (SELECT s, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM t WHERE n_tokens > 0 GROUP BY s),
total AS (SELECT CAST(sum(tokens) AS BIGINT) AS b FROM q),
sh AS MATERIALIZED (SELECT s, tokens, tokens / b AS share, b FROM q, total),
goal AS MATERIALIZED (SELECT (sum(-share * ln(share)) + ln(count(*))) / 2 AS h FROM sh),
bis(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, (SELECT ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * (lo + hi) / 2 * ln(share)) / sum(pow(share, (lo + hi) / 2)) FROM sh) >= (SELECT h FROM goal) AS ok FROM bis WHERE i < 40)),
rep(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN many THEN (lo + hi) / 2 ELSE lo END, CASE WHEN many THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, (SELECT max(pow(share, (lo + hi) / 2) * b / tokens) / sum(pow(share, (lo + hi) / 2)) FROM sh) > 4.0 AS many FROM rep WHERE i < 40)),
x AS (SELECT round(CASE WHEN (SELECT ln(count(*)) - sum(-share * ln(share)) <= 0 FROM sh) THEN 1.0
  ELSE greatest((SELECT lo FROM bis WHERE i = 40), (SELECT lo FROM rep WHERE i = 40)) END, 6) AS x),
w AS (SELECT s, tokens, b, round(pow(share, x.x) / (SELECT sum(pow(share, x.x)) FROM sh), 9) AS weight FROM sh, x),
p AS (SELECT *, CAST(floor(weight * b) AS BIGINT) AS budget FROM w),
pp AS (SELECT *, budget // tokens AS blocks, budget - budget // tokens * tokens AS rest FROM p),
o AS (SELECT t.*, weight, blocks, rest, CASE WHEN n_tokens > 0 THEN sum(n_tokens) OVER (PARTITION BY t.s ORDER BY md5('17:' || blocks || ':' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(text)))) END AS upto FROM t LEFT JOIN pp USING (s))
SELECT doc_id, source, n_tokens, coalesce(weight, 0.0) AS weight, CAST(CASE WHEN n_tokens > 0 THEN blocks + CASE WHEN upto <= rest THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies FROM o
"""
