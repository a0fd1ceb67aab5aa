"""Deterministic samples and splits: order is by a hash of seed and key, counts are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.audit import fold_assignment, fold_check, max_group_folds, salted_folds


def shuffled(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def class_cap(rows: DataFrame, y: str, key: str, ratio: float = 3.0, seed: int = 42) -> DataFrame:
    """All mismatches, and at most int(mismatches * ratio) matches, chosen by hash."""
    limit = rows.agg(F.floor(F.count_if(F.col(y) == 0) * F.lit(ratio)).alias("cap")).first()[0]
    return rows.where(F.col(y) == 0).unionByName(smallest(rows.where(F.col(y) == 1), int(limit), key, seed))


def smallest(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, those with the smallest hashes (ties by key)."""
    return rows.withColumn("__h", shuffled(seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return smallest(rows, n, key, seed)


def ranked(rows: DataFrame, key: str, by: list[str], seed: int = 42) -> DataFrame:
    """rows with rank, from 1 in the hash order within by, and size."""
    w = Window.partitionBy(*by)
    return rows.withColumn("__h", shuffled(seed, F.col(key))).withColumns({"rank": F.row_number().over(w.orderBy("__h", key)), "size": F.count("*").over(w)}).drop("__h")


def figure_split(figures: DataFrame, key: str, family: str, ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """figures with split: within each family, the share ratio (rounded half to even) is val; at least one of five or more, never all."""
    n = F.bround(F.col("size") * F.lit(ratio)).cast("int")
    n_val = F.least(F.when(F.col("size") >= 5, F.greatest(F.lit(1), n)).otherwise(n), F.col("size") - 1)
    return ranked(figures, key, [family], seed).withColumn("split", F.when(F.col("rank") <= n_val, "val").otherwise("train")).drop("rank", "size")


def train_test(rows: DataFrame, key: str, share: float = 0.7, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """rows with is_train: exactly the rounded share of all, or of each class."""
    return ranked(rows, key, by or [], seed).withColumn("is_train", F.col("rank") <= F.bround(F.col("size") * F.lit(share))).drop("rank", "size")


def grouped_split(rows: DataFrame, group: str, y: str = "y", ratio: float = 0.2) -> DataFrame:
    """rows with is_validation: the dealt fold closest to ratio, then to the overall share of match; groups stay whole."""
    stats = rows.agg(F.count("*"), F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0), F.count_distinct(group)).first()
    n, pos, neg, groups = stats
    if n < 4 or not pos or not neg:
        raise ValueError("a grouped split needs four rows and both classes")
    folds = fold_assignment(rows, group, max_group_folds(ratio, groups, min(pos, neg)), y).cache()
    size = F.col("match") + F.col("mismatch")
    key = F.struct(F.abs(size / F.lit(n) - ratio), F.abs(F.col("match") / size - F.lit(pos / n)), "fold")
    best = fold_check(folds).where("valid").agg(F.min_by("fold", key)).first()[0]
    if best is None:
        raise ValueError("no fold has both classes on both sides")
    chosen = folds.where(F.col("fold") == best).select(F.col("group").alias(group), F.lit(True).alias("is_validation"))
    return rows.join(chosen, group, "left").withColumn("is_validation", F.coalesce("is_validation", F.lit(False)))


def repeated_folds(rows: DataFrame, group: str, repeats: int = 5, k: int = 5, y: str = "y", seed: int = 42) -> DataFrame:
    """repeat, group and fold: the greedy deal, its order salted for each repeat."""
    return salted_folds(rows, group, [f"{seed + r}:" for r in range(repeats)], k, y).select("repeat", "group", "fold")


def unpaired_quota(paired: DataFrame, unpaired: DataFrame, keys: list[str], key: str, share: float = 0.5, seed: int = 42) -> DataFrame:
    """Of the unpaired rows, at most the rounded share of the paired ones in each combination of keys."""
    quota = paired.groupBy(*keys).agg(F.bround(F.count("*") * F.lit(share)).cast("int").alias("quota"))
    return ranked(unpaired, key, keys, seed).join(quota, keys, "left").where(F.col("rank") <= F.coalesce("quota", F.lit(0))).drop("rank", "size", "quota")


def pools(rows: DataFrame, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """rows with pool: the first of a shuffled order go to the first pool, and so on, without replacement; the rest is left out."""
    upto, out = 0, F.lit(None).cast("string")
    for name, n in sizes.items():
        out = F.when((F.col("rank") > upto) & (F.col("rank") <= upto + n), name).otherwise(out)
        upto += n
    first = smallest(rows, upto, key, seed)
    return ranked(first, key, [], seed).withColumn("pool", out).drop("rank", "size")


def pair_batches(rows: DataFrame, group: str, batch: int, seed: int = 0) -> DataFrame:
    """rows with batch_id: whole groups side by side in shuffled order; a group that is larger than a batch is cut.

    Batches are formed within hash buckets, so no task deals all groups.
    """
    import pandas as pd

    schema = rows.schema.add("batch_id", "string")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, current, left, n = [""] * len(pdf), 0, batch, int(pdf["__b"].iloc[0])
        order = pdf.reset_index(drop=True).sort_values(["__h", group], kind="stable")
        for _, members in order.groupby("__h", sort=False):
            if len(members) > left and left < batch:
                current, left = current + 1, batch
            for i in members.index:
                if not left:
                    current, left = current + 1, batch
                ids[i] = f"{n}-{current}"
                left -= 1
        return pdf.drop(columns=["__b", "__h"]).assign(batch_id=ids)

    keyed = rows.withColumn("__h", shuffled(seed, F.col(group))).withColumn("__b", F.pmod(F.xxhash64(group), F.lit(parts)))
    return keyed.groupBy("__b").applyInPandas(run, schema)


def split_fingerprint(rows: DataFrame, sample_id: str, order: str, by: list[str] | None = None) -> DataFrame:
    """SHA-256 of the ids in order, one a line."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(sample_id).cast("string").alias("s")))), lambda x: x["s"])
    grouped = rows.groupBy(*by) if by else rows
    return grouped.agg(F.sha2(F.array_join(ids, "\n"), 256).alias("fingerprint"), F.count("*").alias("n"))
