"""Class-wise quality of decisions, ranking quality, and losses, each as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.prefix import prefix_sums


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def f1_columns(tp: Column, fp: Column, fn: Column, empty: float = 0.0) -> dict[str, Column]:
    """precision, recall and f1; empty is what they are where there is nothing at all (graphs: 1, classes: 0)."""
    nothing = (tp + fp + fn) == 0
    return {
        "precision": F.when(nothing, empty).otherwise(ratio(tp, tp + fp)),
        "recall": F.when(nothing, empty).otherwise(ratio(tp, tp + fn)),
        "f1": F.when(nothing, empty).otherwise(ratio(2 * tp, 2 * tp + fp + fn)),
    }


def confusion(y: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn and tn with match (true, 1) as positive."""
    y, p = y.cast("boolean"), predicted.cast("boolean")
    return [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]


def from_confusion() -> dict[str, Column]:
    """All metrics over columns tp, fp, fn and tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    match, other = f1_columns(tp, fp, fn), f1_columns(tn, fn, fp)
    return {
        "n": tp + fp + fn + tn,
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": match["precision"], "recall": match["recall"], "f1": match["f1"],
        "precision_mismatch": other["precision"], "recall_mismatch": other["recall"], "f1_mismatch": other["f1"],
        "macro_f1": (match["f1"] + other["f1"]) / 2,
        "min_class_f1": F.least(match["f1"], other["f1"]),
        "support_match": tp + fn, "support_mismatch": fp + tn,
    }


def classwise_metrics(rows: DataFrame, y: str = "y", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """A row of metrics, or one for each group of by."""
    grouped = rows.groupBy(*by) if by else rows
    return grouped.agg(*confusion(F.col(y), F.col(predicted))).withColumns(from_confusion())


def metrics_by_domain(rows: DataFrame, domain: str, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """Each domain's metrics and, with a null domain, those of all rows, in one pass."""
    return rows.rollup(domain).agg(*confusion(F.col(y), F.col(predicted))).withColumns(from_confusion())


def at_threshold(rows: DataFrame, threshold: float | Column, y: str = "y", score: str = "score") -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return classwise_metrics(rows.withColumn("predicted", F.col(score) >= t), y)


def roc_auc(rows: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Area under the curve, ties at their mid-rank; null unless there are both classes.

    Rows are first counted by score; what is ranked are the distinct scores.
    """
    by = by or []
    hist = rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    ranked = prefix_sums(hist, "score", ["neg"], by=by)  # cum_neg: of this score and below
    area = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    out = ranked.groupBy(*by) if by else ranked
    return out.agg((F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double"))).alias("roc_auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def class_report(rows: DataFrame, threshold: float, y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Confusion counts, class-wise metrics and AUC in one row, or one for each group of by; one pass over the rows.

    Rows are counted by score; both the counts at the threshold and the ranks
    come from that histogram.  AUC is null without both classes.
    """
    by = by or []
    hist = rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    ranked = prefix_sums(hist, "score", ["neg"], by=by)
    passes = F.col("score") >= threshold
    counts = [F.sum(F.when(c, F.col(k)).otherwise(0)).alias(name) for name, c, k in (("tp", passes, "pos"), ("fp", passes, "neg"), ("fn", ~passes, "pos"), ("tn", ~passes, "neg"))]
    area = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    out = (ranked.groupBy(*by) if by else ranked).agg(*counts, F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))
    return out.withColumns(from_confusion())


def summarize_predictions(rows: DataFrame, label: str = "label", predicted: str = "pred_label", score: str = "prob_keep", verdict: str = "verdict", missing: float = 0.5) -> DataFrame:
    """One row: metrics over labelled rows, AUC, and counts by verdict and by prediction over all."""
    labelled = rows.where(F.col(label).isin("match", "mismatch")).select((F.col(label) == "match").cast("int").alias("y"), (F.coalesce(F.col(predicted), F.lit("")) == "match").cast("int").alias("predicted"), F.coalesce(F.col(score), F.lit(missing)).alias("score"))
    counts = lambda c, name: rows.groupBy(F.coalesce(F.col(c), F.lit("none")).alias("k")).count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "count")))).alias(name))  # noqa: E731  a row for each verdict
    out = classwise_metrics(labelled).withColumnRenamed("n", "n_labeled").crossJoin(roc_auc(labelled).select("roc_auc")).crossJoin(rows.agg(F.count("*").alias("n")))
    return out.crossJoin(counts(verdict, "by_verdict")).crossJoin(counts(predicted, "by_pred_label"))


def split_summary(rows: DataFrame, y: str = "y", p: str = "score") -> DataFrame:
    """Mean scores of either class (NaN without rows), the margin between them, and shares on the right side of one half."""
    mean = lambda v: F.coalesce(F.avg(F.when(F.col(y) == v, F.col(p))), F.lit(float("nan")))
    share = lambda v, ok: F.coalesce(F.avg(F.when(F.col(y) == v, ok.cast("double"))), F.lit(float("nan")))
    out = rows.agg(mean(1).alias("mean_match"), mean(0).alias("mean_mismatch"), share(1, F.col(p) >= 0.5).alias("match_above_half"), share(0, F.col(p) < 0.5).alias("mismatch_below_half"))
    return out.withColumn("margin", F.col("mean_match") - F.col("mean_mismatch"))


def bag_counts(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp and fn of two bags of keys (null-safe on nothing: keys are not null)."""
    a, b = predicted.groupBy(*keys).agg(F.count("*").alias("a")), gold.groupBy(*keys).agg(F.count("*").alias("b"))
    both = a.join(b, keys, "full_outer").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    out = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("tp", F.least("a", "b")), ("fp", F.greatest(F.lit(0), F.col("a") - F.col("b"))), ("fn", F.greatest(F.lit(0), F.col("b") - F.col("a"))))])
    return out.withColumns(f1_columns(F.col("tp"), F.col("fp"), F.col("fn"), empty=1.0))


def set_counts(a: Column, b: Column) -> dict[str, Column]:
    return {"tp": F.size(F.array_intersect(a, b)), "fp": F.size(F.array_except(a, b)), "fn": F.size(F.array_except(b, a))}


def pair_hinge(rows: DataFrame, group: str, y: str = "y", logit: str = "logit", margin: float = 0.2) -> DataFrame:
    """Mean over groups with both classes of how far the match falls short of beating the mismatch by margin; 0 without such groups."""
    means = rows.groupBy(group).agg(F.avg(F.when(F.col(y) >= 0.5, F.col(logit))).alias("p"), F.avg(F.when(F.col(y) < 0.5, F.col(logit))).alias("n"))
    both = means.where(F.col("p").isNotNull() & F.col("n").isNotNull())
    return both.agg(F.coalesce(F.avg(F.greatest(F.lit(0.0), F.lit(margin) - F.col("p") + F.col("n"))), F.lit(0.0)).alias("loss"), F.count("*").alias("n_groups"))


def weighted_loss(rows: DataFrame, loss: str = "loss", n: str = "n") -> DataFrame:
    return rows.agg(F.try_divide(F.sum(F.col(loss) * F.col(n)), F.sum(n)).alias("loss"))
