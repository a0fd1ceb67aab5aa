"""Readers: JSON lines strict and tolerant, figure trees with sidecars, annotations, feature tables, configuration.

Paths are any that Spark reads.  Trees are listed by Spark as files, so images
are read only where their bytes are asked for.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions import features as feature_functions
from pairlens.functions.keys import caption_of, domain_of, is_fail_split, pair_group, premise_of, short_caption, strip
from pairlens.operators.matching import first_preferred, merge_reasons
from pairlens.operators.splits import class_cap, sample
from pairlens.sources import schemas

IMAGES = ("png", "jpg", "jpeg", "webp", "bmp")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and ordinal, which is in the order of files and of lines within them."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return text.select("value", F.struct("file", "block", "at").alias("ordinal"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Strict: a line that is no JSON object raises; blank lines are skipped."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tolerant: a last line that was cut off is left out, as are values that are no objects; any other bad line raises."""
    rows = lines(spark, path).where(strip("value") != "").withColumn("json", F.try_parse_json("value"))
    last = rows.agg(F.max("ordinal").alias("last"))
    rows = rows.crossJoin(F.broadcast(last))  # one row
    torn = F.col("json").isNull() & (F.col("ordinal") == F.col("last"))
    bad = F.col("json").isNull() & (F.col("ordinal") != F.col("last"))
    kept = rows.where(~torn).withColumn("value", F.when(bad, F.raise_error(F.lit("a line before the last is no JSON"))).otherwise(F.col("value")))
    return kept.where(F.col("value").rlike(r"^\s*\{")).select("ordinal", F.from_json("value", schema).alias("r")).select("ordinal", "r.*")


def read_holdout(spark: SparkSession, figures_dir: str, limit: int | None = None) -> DataFrame:
    """The holdout's records, or the first limit of them in the order of the file."""
    path = f"{figures_dir}/golden/golden.jsonl"
    rows = lines(spark, path).where(strip("value") != "").select("ordinal", F.from_json("value", schemas.HOLDOUT, {"mode": "FAILFAST"}).alias("r"))
    if limit is not None:
        rows = rows.orderBy("ordinal").limit(limit)
    return rows.select("r.*")


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, relative (below root), split (its first segment), folder, stem and suffix of every file."""
    cols = ["path", "length", *(["content"] if content else [])]
    # paths come with their scheme; the root's last segments tell where they begin to differ
    mark = "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"
    out = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(*cols)
    relative = F.substring_index("path", mark, -1)
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    return out.withColumns({"relative": relative, "split": F.get(parts, F.lit(0)), "folder": F.get(parts, F.size(parts) - 2), "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "suffix": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})


def _open_splits(df: DataFrame) -> DataFrame:
    return df.where((F.lower("split") != "golden") & ~F.startswith("split", F.lit("_")))


def train_splits(spark: SparkSession, figures_dir: str) -> DataFrame:
    """The splits below figures_dir, without the holdout and those whose names begin with an underscore."""
    return _open_splits(files(spark, figures_dir)).where("relative like '%/%'").select("split").distinct().orderBy("split")


def _object(c: Column, schema: str) -> Column:
    """A JSON text's object, or null where it isn't one."""
    return F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*\{"), F.from_json(c, schema))


def sidecars(listed: DataFrame, schema: str = schemas.SIDECAR) -> DataFrame:
    """base (the path without suffix) and side, the record of the JSON file, else the caption of the text file; bad JSON is an empty record."""
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    text = F.col("content").cast("string")
    empty = F.from_json(F.lit("{}"), schema)
    side = F.when(F.col("suffix") == "json", F.coalesce(_object(text, schema), empty)).otherwise(empty.withField("caption", strip(text)))
    rank = F.array_position(F.array(F.lit("json"), F.lit("txt"), F.lit("caption")), F.col("suffix"))
    rows = listed.where(F.col("suffix").isin("json", "txt", "caption")).select(base.alias("base"), F.col("path").alias("sidecar_path"), F.col("suffix").alias("kind"), side.alias("side"), rank.alias("rank"), F.sha2("content", 256).alias("sidecar_sha256"))
    return first_preferred(rows, ["base"], [F.col("rank")]).drop("rank")


def figures(spark: SparkSession, figures_dir: str, require: str | None = None, image_bytes: bool = False) -> DataFrame:
    """A row for each image below figures_dir, without the holdout, with its sidecar's fields and label.

    require: None for any figure_*.png, "json" for figure_* images of any kind
    with a JSON sidecar, "json+caption" for all images whose JSON sidecar has a
    caption or another text.
    """
    listed = _open_splits(files(spark, figures_dir, content=True))
    images = listed.where(F.col("suffix").isin(*(IMAGES if require else ("png",))))
    if require != "json+caption":
        images = images.where(F.startswith("stem", F.lit("figure_")))
    images = images.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("base"), F.col("path").alias("image_path"), "split", "folder", "stem", *([F.sha2("content", 256).alias("image_sha256")] if image_bytes else []))
    side = sidecars(listed)
    if require:
        side = side.where("kind = 'json'")
    rows = images.join(side, "base", "inner" if require else "left")
    s = F.col("side")
    corrupted = F.coalesce(s["gold"]["is_corrupted"], is_fail_split(F.col("split")))
    block = F.coalesce(F.nullif(s["text_block"], F.lit("")), s["premise"], F.lit(""))
    out = rows.select(
        F.coalesce(F.nullif(s["sample_id"], F.lit("")), F.concat_ws("/", "split", "folder", "stem")).alias("sample_id"), "split", domain_of(F.col("split")).alias("domain"),
        F.when(corrupted, "mismatch").otherwise("match").alias("label"), corrupted.cast("int").alias("label_id"), corrupted.alias("gold_is_corrupted"), "image_path", "sidecar_path", *(["image_sha256", "sidecar_sha256"] if image_bytes else []),
        F.coalesce(s["caption"], F.lit("")).alias("caption"), block.alias("text_block"), s["visual_description"].alias("visual_description"), F.coalesce(s["visual_claims"], F.array().cast("array<string>")).alias("visual_claims"), s["visual_annotation"].alias("visual_annotation"), premise_of(s["caption"], s["text_block"], s["premise"]).alias("premise"), s["gold"].alias("gold"),
    )
    out = out.withColumns({"pair_group": pair_group(F.col("sample_id")), "short": short_caption(F.col("caption"), F.col("text_block"), F.col("premise"))})
    return out.where(caption_of(F.col("caption"), F.col("premise"), F.col("text_block")) != "") if require == "json+caption" else out


def train_figures(spark: SparkSession, figures_dir: str, splits: list[str] | None = None, limit: int | None = None, max_ratio: float | None = 3.0, seed: int = 42, require_text: bool = True) -> DataFrame:
    """figures with a premise, matches capped at max_ratio for each mismatch, and at most limit of all."""
    rows = figures(spark, figures_dir)
    rows = rows.where(F.col("split").isin(splits)) if splits else rows
    rows = rows.where("premise != ''") if require_text else rows
    y = rows.withColumn("__y", 1 - F.col("label_id"))
    y = class_cap(y, "__y", "sample_id", max_ratio, seed) if max_ratio is not None else y
    y = y.drop("__y")
    return sample(y, limit, "sample_id", seed) if limit is not None else y


def guard_validation(path: str) -> str:
    """path, unless one of its segments is the holdout's."""
    if "golden" in re.split(r"[/\\]", path.lower()):
        raise ValueError("validation may not come from the holdout")
    return path


def read_validation(spark: SparkSession, path: str | None, figures_dir: str) -> DataFrame:
    rows = read_jsonl(spark, guard_validation(path), schemas.FIGURE) if path else figures(spark, figures_dir, "json+caption")
    if rows.isEmpty():
        raise ValueError("no validation rows")
    return rows


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table with y (1: match) and all derived features; raises on columns that are missing or unknown, holdout rows, labels that disagree, numbers that aren't finite, or a single class."""
    base, derived = feature_functions.names(), feature_functions.DERIVED
    header = spark.read.option("header", True).csv(path).columns
    wanted = ["sample_id", "split", "label", "label_id", *base]
    if missing := [c for c in wanted if c not in header]:
        raise ValueError(f"columns are missing: {missing}")
    if unknown := [c for c in header if c not in wanted + derived]:
        raise ValueError(f"columns are unknown: {unknown}")
    kinds = {"sample_id": "string", "split": "string", "label": "string", "label_id": "int"}
    rows = spark.read.option("header", True).option("mode", "FAILFAST").schema(", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in header)).csv(path)
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in base]
    all_finite = finite[0]
    for f in finite[1:]:
        all_finite = all_finite & f
    n, holdout, labels, agree, good, classes = rows.agg(
        F.count("*"), F.count_if(F.lower(F.concat_ws("/", "sample_id", "split")).contains("golden")), F.count_if(~F.coalesce(F.col("label").isin("match", "mismatch"), F.lit(False))),
        F.count_if((F.col("label") == "match").cast("int") != F.col("label_id")), F.count_if(~all_finite), F.count_distinct("label"),
    ).first()
    for bad, what in ((not n, "no rows"), (holdout, "holdout rows"), (labels, "labels other than match and mismatch"), (agree, "label and label_id that disagree"), (good, "features that are not finite"), (classes < 2, "one class only")):
        if bad:
            raise ValueError(f"{path}: {what}")
    computed = feature_functions.derived()
    return rows.withColumns({d: F.coalesce(F.col(d), computed[d]) if d in header else computed[d] for d in derived}).withColumn("y", F.col("label_id"))


def unique_figures(spark: SparkSession, figures_dir: str, splits: list[str] | None = None) -> DataFrame:
    """One row with claims for each figure, of an original split where there is one."""
    from pairlens.functions.keys import figure_key

    listed = files(spark, figures_dir, content=True).where("suffix = 'json' and stem like 'figure\\_%'")
    listed = listed.where(F.col("split").isin(splits)) if splits else listed
    rows = listed.select("path", "split", "folder", "stem", _object(F.col("content").cast("string"), schemas.SIDECAR).alias("s")).where("s is not null")
    claims = F.filter(F.coalesce(F.col("s.visual_claims"), F.array().cast("array<string>")), lambda c: strip(c) != "")
    rows = rows.select("path", "split", figure_key(F.col("split"), F.col("folder"), F.col("stem")).alias("figure_key"), claims.alias("claims")).where("size(claims) > 0")
    return first_preferred(rows, ["figure_key"], [~F.endswith("split", F.lit("_orig")), F.col("path")])


def annotations(spark: SparkSession, roots: list[str]) -> DataFrame:
    """key, annotator and text of the figure_*.txt files below the roots; blank ones are skipped, a key that is there twice raises."""
    from pairlens.functions.keys import annotation_key

    parts = [files(spark, r, content=True).where("suffix = 'txt' and stem like 'figure\\_%'").select(annotation_key(F.col("relative")).alias("key"), F.lit(os.path.basename(r.rstrip("/"))).alias("annotator"), strip(F.col("content").cast("string")).alias("text"), "path") for r in roots]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where("key is not null and text != ''")
    if twice := rows.groupBy("key").count().where("count > 1").limit(1).collect():
        raise ValueError(f"two annotations of {twice[0].key}")
    return rows


def reasons(spark: SparkSession, path: str) -> DataFrame:
    """domain (from the file's name), document, figure reference, and its objects and lies merged in order."""
    from pairlens.functions.keys import document_id
    from pairlens.functions.text import figure_ref

    rows = spark.read.option("multiLine", True).schema(schemas.REASON).json(path).withColumn("domain", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    each = rows.select("domain", document_id(F.lit(None).cast("string"), F.coalesce("local_pdf_path", "file")).alias("document"), F.posexplode("fixed").alias("at", "f")).select("domain", "document", "at", F.col("f.object").alias("object"), F.col("f.lie").alias("lie"))
    named = each.where(F.lower("object").contains("figure")).withColumn("ref", figure_ref(F.col("object")))
    named = named.select("*", "ref.number", "ref.panel")
    return merge_reasons(named, ["domain", "document", "number", "panel"], "at")


def class_images(spark: SparkSession, root: str, classes: list[str]) -> DataFrame:
    """path and class number of the images of a tree with a folder for each class."""
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("split")) - 1
    return files(spark, root).where(F.col("split").isin(classes) & F.col("suffix").isin(*IMAGES)).select("path", F.col("split").alias("class"), number.cast("int").alias("label"))


def interpolate(value, environment=None):
    """${NAME} and ${NAME:default} in strings, through lists and dicts; a name without value or default raises."""
    env = os.environ if environment is None else environment
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def fill(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise KeyError(m[1])
        return m[2]

    return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", fill, value)


def read_config(path: str) -> dict:
    """A YAML file with its variables filled in."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return interpolate(yaml.safe_load(f) or {})
