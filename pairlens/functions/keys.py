"""Column expressions for keys, labels and fall-backs of paired records.

Empty and missing are alike wherever a value falls back to the next one, and
white space is Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAIL, ORIG = "_l2_fail", "_orig"
MISMATCH_WORDS = ["mismatch", "regenerate", "corrupted", "fail", "1"]
MATCH_WORDS = ["match", "pass", "clean", "0"]


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def first_text(*cols: Column | str) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols], F.lit(""))


def premise_of(caption: Column, text_block: Column, premise: Column) -> Column:
    block, cap = strip(F.coalesce(text_block, F.lit(""))), strip(F.coalesce(caption, F.lit("")))
    return strip(first_text(premise, block, cap))


def caption_of(caption: Column, premise: Column, text_block: Column) -> Column:
    return strip(first_text(caption, premise, text_block))


def short_caption(caption: Column, text_block: Column, premise: Column, longest: int = 280) -> Column:
    """The caption, else the first figure reference with its sentence, else the first sentence."""
    cap = strip(F.coalesce(caption, F.lit("")))
    blob = strip(first_text(text_block, premise))
    figure = r"(?i)(?:fig(?:ure)?\.?\s*\d+[a-z]?)\s*[:.\-–—]?\s*[^\n.!?]{8,200}"
    found = squeeze(F.regexp_extract(blob, figure, 0))
    sentence = squeeze(F.element_at(F.split(blob, r"(?<=[.!?])\s+", 2), 1))
    return F.when(cap != "", F.substring(cap, 1, longest)).when(found != "", F.substring(found, 1, longest)).otherwise(F.substring(sentence, 1, longest))


def is_match(label: Column, corrupted: Column | None = None, gold_corrupted: Column | None = None, label_id: Column | None = None) -> Column:
    """True for match; flags first, then label words, then the number (1: mismatch); anything else raises."""
    word = F.lower(F.coalesce(label, F.lit("")))
    by_word = F.when(word.isin(MISMATCH_WORDS), F.lit(False)).when(word.isin(MATCH_WORDS), F.lit(True))
    sources = [~c for c in (corrupted, gold_corrupted) if c is not None] + [by_word] + ([label_id == 0] if label_id is not None else [])
    return F.coalesce(*sources, F.raise_error(F.lit("a record without a binary label")).cast("boolean"))


def pair_group(sample_id: Column, short: str = "strip") -> Column:
    """The id without the variant suffix of its first segment.  Ids of fewer than three segments: "strip" too, "keep" as they are, or "raise"."""
    out = F.regexp_replace(sample_id, rf"^([^/]*?)(?:{FAIL}|{ORIG})(?=/|$)", "$1")
    enough = F.size(F.split(sample_id, "/")) >= 3
    if short == "keep":
        return F.when(enough, out).otherwise(sample_id)
    if short == "raise":
        return F.when(enough, out).otherwise(F.raise_error(F.concat(F.lit("too few segments: "), sample_id)))
    return out


def source_group(source_id: Column, sample_id: Column, path: Column) -> Column:
    """Like pair_group for every segment, of the first id there is; backslashes count as slashes."""
    value = F.regexp_replace(first_text(source_id, sample_id, path), r"\\", "/")
    return F.array_join(F.transform(F.split(value, "/"), lambda s: F.regexp_replace(s, f"(?:{FAIL}|{ORIG})$", "")), "/")


def domain_of(split: Column) -> Column:
    return F.regexp_replace(split, f"(?:{FAIL}|{ORIG})$", "")


def domain_of_id(sample_id: Column) -> Column:
    return domain_of(F.split_part(sample_id, F.lit("/"), F.lit(1)))


def family_of(split: Column) -> Column:
    return F.replace(F.replace(split, F.lit(FAIL), F.lit("")), F.lit(ORIG), F.lit(""))


def figure_key(split: Column, document: Column, stem: Column) -> Column:
    return F.concat_ws("/", family_of(split), document, stem)


def is_fail_split(split: Column) -> Column:
    return F.lower(split).contains("l2_fail")


def is_holdout(split: Column, path: Column) -> Column:
    """Whether a row belongs to the holdout ("golden") part, by split or by any segment of its path."""
    return (F.lower(F.coalesce(split, F.lit(""))) == "golden") | F.array_contains(F.split(F.lower(F.coalesce(path, F.lit(""))), r"[/\\]"), "golden")


def sample_id_of(sample_id: Column, other: Column, ordinal: Column) -> Column:
    return F.coalesce(F.nullif(sample_id, F.lit("")), F.nullif(other, F.lit("")), F.concat(F.lit("row-"), ordinal.cast("string")))


def image_of(path: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(other, F.lit("")), F.raise_error(F.lit("a record without an image path")))


def document_id(index_file: Column, file: Column) -> Column:
    """The document named by the index, else by the file; null unless it reads document_*."""
    value = F.regexp_replace(first_text(index_file, file), r"^.*/|\.[^./]*$", "")
    return F.when(value.startswith("document_"), value)


def annotation_key(path: Column) -> Column:
    """golden/split/document/stem or split/document/stem of an annotation below its root; null for other places."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    head = F.element_at(parts, 1)
    return F.when((head == "golden") & (F.size(parts) >= 4), F.concat_ws("/", F.lit("golden"), F.get(parts, 1), F.get(parts, 2), stem)).when(head.endswith(ORIG) & (F.size(parts) >= 3), F.concat_ws("/", head, F.get(parts, 1), stem))


def fail_key(key: Column) -> Column:
    """The key of the failing twin of an original, within the holdout or outside of it."""
    return F.regexp_replace(key, rf"^((?:golden/)?[^/]*?){ORIG}(?=/)", f"$1{FAIL}")


def verdict(probability: Column, threshold: float | Column = 0.5) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.struct(F.when(probability >= t, "PASS").otherwise("REGENERATE").alias("verdict"), F.when(probability >= t, "match").otherwise("mismatch").alias("label"))


#: Columns that a variant of the features goes without.
VARIANTS = {
    "full": (),
    "no_router": ("p_byt", "p_video", "p_graph", "p_scheme", "sem_w", "struct_w", "obj_w", "router_conf"),
    "no_judge_a": ("score_sem", "sem_w"),
    "no_judge_b": ("score_struct", "struct_w"),
    "no_judge_c": ("score_obj", "obj_w"),
}
ROUTER = ("p_byt", "p_video", "p_graph", "p_scheme", "router_conf")


def variant(features: DataFrame, name: str) -> DataFrame:
    if name == "router_only":
        return features.select(*[c for c in features.columns if c in ROUTER])
    return features.drop(*VARIANTS[name])


def sample_ids(rows: DataFrame, column: str = "sample_id") -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct()
