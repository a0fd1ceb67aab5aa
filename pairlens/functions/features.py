"""Score features: weights by router, margins, disagreement, and distances of paired vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ["score_sem", "score_struct", "score_obj"]
ROUTER = ["p_byt", "p_video", "p_graph", "p_scheme"]
WEIGHTED = ["sem_w", "struct_w", "obj_w", "router_conf"]
IMAGE_META = ["ratio", "mean_brightness", "std_brightness", "entropy", "edge_density", "color_variance", "texture_contrast", "num_blobs", "avg_blob_area", "horizontal_lines", "vertical_lines", "symmetry_score", "saturation_mean", "saturation_std", "sharpness"]
DERIVED = ["sem_margin", "struct_margin", "obj_margin", "judge_mean", "judge_std", "judge_range", "judge_disagreement_mean", "router_entropy", "router_margin", "ocr_text_consistency", "ocr_numeric_consistency"]


def names() -> list[str]:
    from pairlens.functions.text import TEXT_META

    return [*SCORES, *ROUTER, *WEIGHTED, *IMAGE_META, *TEXT_META]


def weighted() -> dict[str, Column]:
    c = F.col
    return {
        "sem_w": c("score_sem") * (c("p_byt") + c("p_video")),
        "struct_w": c("score_struct") * (c("p_graph") + c("p_scheme")),
        "obj_w": c("score_obj") * (c("p_scheme") + c("p_byt")),
        "router_conf": F.greatest(*ROUTER),
    }


def derived() -> dict[str, Column]:
    """Eleven more, from the scores, the router's probabilities and has_numbers."""
    a, b, c = (F.col(x) for x in SCORES)
    mean = (a + b + c) / 3
    clipped = F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(x))) for x in ROUTER])
    total = F.greatest(F.aggregate(clipped, F.lit(0.0), lambda s, x: s + x), F.lit(1e-12))
    share = F.transform(clipped, lambda x: x / total)
    ranked = F.sort_array(share, asc=False)
    return {
        "sem_margin": F.abs(a - 0.5),
        "struct_margin": F.abs(b - 0.5),
        "obj_margin": F.abs(c - 0.5),
        "judge_mean": mean,
        "judge_std": F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / 3),
        "judge_range": F.greatest(a, b, c) - F.least(a, b, c),
        "judge_disagreement_mean": (F.abs(a - b) + F.abs(a - c) + F.abs(b - c)) / 3,
        "router_entropy": -F.aggregate(share, F.lit(0.0), lambda s, x: s + x * F.log(F.greatest(x, F.lit(1e-12)))) / math.log(len(ROUTER)),
        "router_margin": F.element_at(ranked, 1) - F.element_at(ranked, 2),
        "ocr_text_consistency": b,
        "ocr_numeric_consistency": F.when(F.coalesce(F.col("has_numbers"), F.lit(0.0)) != 0, b).otherwise(0.5),
    }


def add_features(df: DataFrame) -> DataFrame:
    return df.withColumns(weighted()).withColumns(derived())


def with_histogram(df: DataFrame, values: str, out: str = "histogram", low: float = 0.0, high: float = 256.0, bins: int = 256) -> DataFrame:
    """df with out: how many of an array's values fall into each of bins equal parts of [low, high), as a map of the filled parts.

    Other values, nulls and NaN fall into none; a null array has no histogram.
    The bins are sorted once and counted by where runs begin, in columns of
    their own, so that no expression is repeated for each value.
    """
    place = lambda x: F.least(F.floor((x.cast("double") - low) * (bins / (high - low))).cast("int"), F.lit(bins - 1))
    inside = F.filter(values, lambda x: (x >= low) & (x < high))
    df = df.withColumn("__bins", F.sort_array(F.transform(inside, place)))
    n = F.size("__bins")
    starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get("__bins", i) != F.get("__bins", i - 1)))
    df = df.withColumn("__starts", F.when(F.col("__bins").isNotNull(), F.array_distinct(starts)))
    runs = F.slice("__starts", F.lit(1), F.size("__starts") - 1)
    counted = F.transform(runs, lambda s, i: F.struct(F.get("__bins", s).alias("bin"), (F.get("__starts", i + 1) - s).alias("n")))
    return df.withColumn(out, F.map_from_entries(counted)).drop("__bins", "__starts")


def entropy_bits(counts: Column) -> Column:
    """Entropy, in bits, of an array of counts; 0 without any."""
    total = F.greatest(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    weighted = F.aggregate(counts, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    return F.greatest(F.log2(total) - weighted / total, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def match_features(a: Column, b: Column) -> Column:
    """[u, v, uv, |u - v|] of two vectors at unit length, what a matching head takes."""
    unit = lambda x: F.transform(x, lambda e: e / F.sqrt(dot(x, x)))
    u, v = unit(a), unit(b)
    return F.concat(u, v, F.zip_with(u, v, lambda x, y: x * y), F.zip_with(u, v, lambda x, y: F.abs(x - y)))


def focal_loss(logit: Column, target: Column, gamma: float = 2.0, positive_weight: float = 1.0) -> Column:
    p = 1 / (1 + F.exp(-logit))
    pt = F.when(target == 1, p).otherwise(1 - p)
    weight = F.when(target == 1, positive_weight).otherwise(1.0)
    return F.pow(1 - pt, F.lit(gamma)) * weight * -F.log(pt)


def uniform_router(n: int = 4) -> Column:
    return F.array(*[F.lit(1.0 / n)] * n)
