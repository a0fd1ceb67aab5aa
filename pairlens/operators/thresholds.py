"""Decision thresholds: five rules over one histogram of scores.

Scores are counted by value and class; candidate thresholds join the histogram
as values without rows, and one running sum from the top gives every
candidate's confusion counts.  A score passes if it is at least the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pairlens.operators.metrics import from_confusion
from pairlens.operators.prefix import prefix_sums

#: 0.01, 0.02, ... 0.99 as a linear division of the interval gives them.
GRID = [0.01 + i * ((0.99 - 0.01) / 98) for i in range(98)] + [0.99]


def counted(rows: DataFrame, y: str = "y", score: str = "score") -> tuple[DataFrame, Row]:
    """The histogram (t, pos, neg), kept for the jobs that follow so that scores are computed once, and its low, high, pos and neg."""
    t, pos, neg = F.col(score).cast("double").alias("t"), F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    hist = rows.groupBy(t).agg(pos, neg).persist()
    bad = F.col("t").isNull() | F.isnan("t") | (F.abs("t") == float("inf"))
    facts = hist.agg(F.count_if(bad).alias("bad"), F.min("t").alias("low"), F.max("t").alias("high"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    if facts.bad:
        raise ValueError("scores must be finite")
    return hist, facts


def with_candidates(hist: DataFrame, extra: list[float]) -> DataFrame:
    """hist with candidates that need not be scores, as values without rows."""
    more = hist.sparkSession.createDataFrame([(float(x), 0, 0) for x in extra], "t double, pos long, neg long")
    return hist.unionByName(more).groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def sweep(hist: DataFrame) -> DataFrame:
    """hist (t, pos, neg) with tp, fp, fn and tn of each threshold t."""
    total = hist.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    out = prefix_sums(hist, "t", ["pos", "neg"], descending=True).crossJoin(F.broadcast(total))  # one row
    return out.select("t", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), (F.col("all_pos") - F.col("cum_pos")).alias("fn"), (F.col("all_neg") - F.col("cum_neg")).alias("tn"))


def _best(swept: DataFrame, key: list[Column], by: list[str] | None = None) -> DataFrame:
    """The row of the largest key, which ends with -t, or that of each group; one aggregation."""
    m = swept.withColumns(from_confusion())
    cols = ["t", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "f1_mismatch", "macro_f1", "min_class_f1"]
    best = (m.groupBy(*by) if by else m).agg(F.max_by(F.struct(*cols), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])).alias("b"))
    return best.select(*(by or []), F.col("b.t").alias("threshold"), *[f"b.{c}" for c in cols[1:]])


def _need_both(facts: Row) -> None:
    if not facts.pos or not facts.neg:
        raise ValueError("thresholds for balance need both classes")


def _balance() -> list[Column]:
    """Weaker class first, then both, accuracy, closeness to one half."""
    return [F.col("min_class_f1"), F.col("macro_f1"), F.col("accuracy"), -F.abs(F.col("t") - 0.5), -F.col("t")]


def best_f1(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Largest F1 of match; among F1s alike to 12 digits the threshold closest to one half, the smaller of two."""
    hist, _ = counted(rows, y, score)
    return _best(sweep(with_candidates(hist, [*GRID, 0.5])), [F.round("f1", 12), -F.abs(F.col("t") - 0.5), -F.col("t")])


def best_balanced_grid(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    hist, facts = counted(rows, y, score)
    _need_both(facts)
    return _best(sweep(with_candidates(hist, [0.0, 0.5, 1.0, *GRID])), _balance())


def best_balanced(rows: DataFrame, y: str = "y", score: str = "score", constants: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """Candidates: the scores, the constants, and the next number above the largest score (nothing passes)."""
    hist, facts = counted(rows, y, score)
    above = [math.nextafter(facts.high, math.inf)] if facts.high is not None else []
    return _best(sweep(with_candidates(hist, [*constants, *above])), _balance())


def best_balanced_by(rows: DataFrame, by: str, y: str = "y", score: str = "score", constants: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """best_balanced for every value of by, all over one histogram, which is kept: rows are read once."""
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(F.col(score)) == float("inf"))
    s = F.when(bad, F.raise_error(F.lit("scores must be finite"))).otherwise(F.col(score).cast("double"))
    hist = rows.groupBy(F.col(by).alias("by"), s.alias("t")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")).persist()
    total = hist.groupBy("by").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.max("t").alias("top"))
    # the next number above: one unit in the last place more
    unit = F.when(F.col("top") == 0, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs("top"))) - 52))
    above = F.when(F.col("top") + unit > F.col("top"), F.col("top") + unit).otherwise(F.col("top") + 2 * unit)
    more = total.select("by", F.explode(F.array(*[F.lit(float(c)) for c in constants], above)).alias("t"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    every = hist.unionByName(more).groupBy("by", "t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist()
    both = F.when((F.col("all_pos") == 0) | (F.col("all_neg") == 0), F.raise_error(F.lit("thresholds for balance need both classes"))).otherwise(F.col("all_pos"))
    swept = prefix_sums(every, "t", ["pos", "neg"], by=["by"], descending=True).join(total.select("by", both.alias("all_pos"), "all_neg"), "by")
    swept = swept.select("by", "t", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), (F.col("all_pos") - F.col("cum_pos")).alias("fn"), (F.col("all_neg") - F.col("cum_neg")).alias("tn"))
    return _best(swept, _balance(), ["by"]).withColumnRenamed("by", by)


def best_balanced_scores(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    return best_balanced(rows, y, score, ())


def best_midpoint(rows: DataFrame, y: str = "y", score: str = "score", objective: str = "f1") -> DataFrame:
    """Candidates halfway between neighbouring scores and just outside of them; y is 1 for match."""
    hist, facts = counted(rows, y, score)
    swept, low, high = sweep(hist), facts.low, facts.high
    if low is None:
        raise ValueError("a threshold needs scores")
    # the threshold below score t passes what the sweep passes at t; its place needs the score before t
    nums = prefix_sums(hist.withColumn("one", F.lit(1).cast("long")), "t", ["one"]).select("t", F.col("cum_one").alias("k"))
    before = nums.select((F.col("k") + 1).alias("k"), F.col("t").alias("before"))
    placed = swept.join(nums, "t").join(before, "k", "left")
    inner = placed.select(F.when(F.col("before").isNull(), F.lit(low - 1e-12)).otherwise((F.col("before") + F.col("t")) / 2).alias("t"), "tp", "fp", "fn", "tn")
    last = swept.where(F.col("t") == high).select(F.lit(high + 1e-12).alias("t"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("fn") + F.col("tp")).alias("fn"), (F.col("tn") + F.col("fp")).alias("tn"))
    return _best(inner.unionByName(last), [F.col(objective), F.col("accuracy"), -F.abs(F.col("t") - 0.5), -F.col("t")])
