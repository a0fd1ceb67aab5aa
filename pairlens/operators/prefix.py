"""Running sums over an order without one task that sees every row."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which an order is cut into ranges, and rows in a range, about.
RANGE_ROWS = 100_000


def prefix_sums(df: DataFrame, order: str, sums: list[str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """df with cum_<c>: the sum of c over this and all earlier values of order, which is distinct within by.

    With more than RANGE_ROWS rows, the order is cut at approximate quantiles;
    running sums within a range start from the sums of the ranges before it, of
    which each group has few.  The cuts are the same for all groups, so a group
    of most rows is cut as well.
    """
    by = by or []
    rows = df.count()
    direction = F.desc if descending else F.asc
    if rows <= RANGE_ROWS:
        w = Window.partitionBy(*by).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"cum_{c}": F.sum(c).over(w) for c in sums})
    n = rows // RANGE_ROWS + 1
    cuts = df.approxQuantile(order, [i / n for i in range(1, n)], 0.1 / n)
    # a binary search for each row, as cuts grow with rows; missing values come before all ranges, NaN behind them
    splits = [-math.inf, *sorted({float(c) for c in cuts if math.isfinite(c)}), math.inf]
    find = Bucketizer(splits=splits, inputCol="__order", outputCol="__at", handleInvalid="keep") if len(splits) > 2 else None
    at = df.withColumn("__order", F.col(order).cast("double"))
    at = find.transform(at) if find else at.withColumn("__at", F.lit(0))
    ranged = at.withColumn("__range", F.when(F.col("__order").isNull(), -1).otherwise(F.col("__at").cast("int"))).drop("__order", "__at")
    w = Window.partitionBy(*by, "__range").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy(direction("__range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__at"), *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums])
    same = F.col("__range") == F.col("__at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = ranged.withColumns({f"cum_{c}": F.sum(c).over(w) for c in sums}).join(totals if by else F.broadcast(totals), same)  # a row for each range, and group
    return out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"__b_{c}") for c in sums}).drop("__range", "__at", *[f"__by_{c}" for c in by], *[f"__b_{c}" for c in sums])
