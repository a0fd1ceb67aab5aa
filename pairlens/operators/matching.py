"""Joins of paired records: sidecars, twins, leakage, resumption, candidates in order, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_preferred(rows: DataFrame, key: list[str], prefer: list[Column]) -> DataFrame:
    """One row for each key, the first in the order of prefer."""
    w = Window.partitionBy(*key).orderBy(*prefer)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def with_sidecars(images: DataFrame, sidecars: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """images with each field from the first sidecar that has the key; sidecars have key and fields, one row a key."""
    out = images
    for i, s in enumerate(sidecars):
        out = out.join(s.select(key, F.struct(*fields).alias(f"__s{i}")), key, "left")
    chosen = F.coalesce(*[F.col(f"__s{i}") for i in range(len(sidecars))])
    return out.withColumn("__s", chosen).select(*images.columns, *[F.col(f"__s.{f}").alias(f) for f in fields])


def collect_pairs(originals: DataFrame, fails: DataFrame, keys: list[str], size: str | None = None, digest: str | None = None) -> DataFrame:
    """Originals with their failing twins, inner; same_bytes compares sizes and then digests."""
    a = originals.select(*keys, *[F.col(c).alias(f"orig_{c}") for c in originals.columns if c not in keys])
    b = fails.select(*keys, *[F.col(c).alias(f"fail_{c}") for c in fails.columns if c not in keys])
    out = a.join(b, keys)
    if size and digest:
        out = out.withColumn("same_bytes", (F.col(f"orig_{size}") == F.col(f"fail_{size}")) & (F.col(f"orig_{digest}") == F.col(f"fail_{digest}")))
    return out


def originals_alone(originals: DataFrame, fails: DataFrame, keys: list[str], prefer: list[Column]) -> DataFrame:
    """Originals without a failing twin, one for each key."""
    return first_preferred(originals.join(fails.select(*keys).distinct(), keys, "left_anti"), keys, prefer)


def leaks(train: DataFrame, held: DataFrame, keys: dict[str, Column | str]) -> DataFrame:
    """kind and value of every key that both sides have."""
    out = None
    for kind, key in keys.items():
        c = F.col(key) if isinstance(key, str) else key
        side = lambda df: df.select(c.cast("string").alias("value")).where("value is not null")  # noqa: B023, E731
        one = side(train).intersect(side(held)).select(F.lit(kind).alias("kind"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def guard_leaks(train: DataFrame, held: DataFrame, keys: dict[str, Column | str]) -> None:
    if found := leaks(train, held, keys).limit(1).collect():
        raise ValueError(f"both sides have {found[0].kind} {found[0].value!r}")


def remaining(todo: DataFrame, done: DataFrame, key: str = "record_key") -> DataFrame:
    """Rows whose key the log doesn't have yet."""
    return todo.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def last_records(log: DataFrame, key: str, ordinal: str) -> DataFrame:
    """For each key its last record as a struct, record."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.col(ordinal)).alias("record"))


def in_expected_order(expected: DataFrame, log: DataFrame, key: str, ordinal: str, strict: bool = True) -> DataFrame:
    """expected with the last record of each key; strict: a key without one raises."""
    out = expected.join(last_records(log, key, ordinal), key, "left")
    if strict:
        out = out.withColumn("record", F.when(F.col("record").isNotNull(), F.col("record")).otherwise(F.raise_error(F.concat(F.lit("no record for "), F.col(key).cast("string")))))
    return out


def resolve(refs: DataFrame, candidates: Column, files: DataFrame, ref: str, path: str = "path") -> DataFrame:
    """refs with the first of an array of candidate paths that exists; null if none does."""
    tried = refs.select(ref, F.posexplode(candidates).alias("priority", path))
    found = tried.join(files.select(path).distinct(), path).groupBy(ref).agg(F.min_by(path, "priority").alias("resolved"))
    return refs.join(found, ref, "left")


def resolve_panel(refs: DataFrame, files: DataFrame, ref: str, folder: str = "folder", number: str = "number", panel: str = "panel") -> DataFrame:
    """refs with the file of the exact panel, else of the whole figure, else, without a panel, the first file that begins like it."""
    base = F.concat(F.col(folder), F.lit("/figure_"), F.col(number))
    exact = resolve(refs, F.filter(F.array(F.concat(base, F.col(panel), F.lit(".png")), F.concat(base, F.lit(".png"))), lambda x: x.isNotNull()), files, ref)
    open_ = exact.where(F.col("resolved").isNull() & F.col(panel).isNull() & F.col(number).isNotNull()).select(ref, base.alias("stem"))
    stem = F.regexp_extract("path", r"^(.*/figure_[0-9]+)[^0-9/][^/]*$", 1)
    globbed = open_.join(files.select("path", stem.alias("stem")), "stem").groupBy(ref).agg(F.min("path").alias("globbed"))
    return exact.join(globbed, ref, "left").withColumn("resolved", F.coalesce("resolved", "globbed")).drop("globbed")


def first_root(refs: DataFrame, files: DataFrame, key: str, root: str, roots: list[str]) -> DataFrame:
    """refs with the path in the first root, in the order of roots, that has the key."""
    rank = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col(root))
    best = files.where(F.col(root).isin(roots)).groupBy(key).agg(F.min_by("path", rank).alias("resolved"))
    return refs.join(best, key, "left")


def inherit(records: DataFrame, annotations: DataFrame, key: str, fields: list[str], drop_missing: bool = False) -> DataFrame:
    """records with fields from annotations by key; without one they keep their own, or lose them with drop_missing."""
    side = annotations.select(key, *[F.col(f).alias(f"__a_{f}") for f in fields])
    out = records.join(side, key, "left")
    value = lambda f: F.col(f"__a_{f}") if drop_missing or f not in records.columns else F.coalesce(f"__a_{f}", f)
    return out.withColumns({f: value(f) for f in fields}).drop(*[f"__a_{f}" for f in fields])


def merge_reasons(rows: DataFrame, key: list[str], order: str, what: str = "object", why: str = "lie") -> DataFrame:
    """For each key the distinct objects and lies in their order, the lies also as one text."""
    listed = lambda c: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))), lambda x: x["v"]))
    out = rows.groupBy(*key).agg(listed(what).alias("objects"), listed(why).alias("lies"))
    return out.withColumn("lie", F.array_join("lies", "; "))


def tree_linear_grid(trees: DataFrame, linear: DataFrame, weights: list[float]) -> DataFrame:
    """All combinations of a tree model, a linear one and a weight of the tree."""
    w = F.explode(F.array(*[F.lit(x) for x in weights])).alias("weight")
    out = trees.select(F.col("name").alias("tree")).crossJoin(linear.select(F.col("name").alias("linear"))).select("tree", "linear", w)
    return out.withColumn("name", F.concat(F.lit("ensemble_"), "tree", F.lit("_"), "linear", F.lit("_xgb"), F.regexp_replace(F.col("weight").cast("string"), r"\.0$", "")))


def rank_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with rank, all keys descending; a table of candidates is small."""
    return candidates.withColumn("rank", F.row_number().over(Window.orderBy(*[F.desc(k) for k in keys])))
