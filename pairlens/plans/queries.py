"""The queries by name, each on the tables below a folder, and SQL for those that SQL can express.

Documents stand for figures, labels.quality for the label (1: match), source
and lang for domains, benchmark for text read from images, and the share of
unique words for a score.
"""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.functions import claimgraph, features, graphs, jsontools, keys, text
from pairlens.operators import audit, bootstrap, matching, metrics, splits, thresholds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with y and score; Spark chooses the join from the sizes it sees."""
    w = text.words(F.coalesce("text", F.lit("")))
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").select("doc_id", "source", "lang", w.alias("w"), "y")
    score = F.when(F.size("w") == 0, 0.0).otherwise(F.size(F.array_distinct(F.transform("w", F.lower))).cast("double") / F.size("w"))
    return docs.select("doc_id", "source", "lang", score.alias("score"), "y")


WORDS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+')"
SCORED = f"""s AS (SELECT doc_id, source, lang, quality AS y,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) END AS score
  FROM (SELECT *, {WORDS} AS w FROM documents) JOIN labels USING (doc_id))"""
SWEPT = """h AS (SELECT t, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg FROM g GROUP BY t),
c AS (SELECT t, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  CAST(sum(pos) OVER () - sum(pos) OVER w AS BIGINT) AS fn, CAST(sum(neg) OVER () - sum(neg) OVER w AS BIGINT) AS tn
  FROM h WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))"""
HIST = "SELECT score AS t, CAST(y = 1 AS BIGINT) AS pos, CAST(y = 0 AS BIGINT) AS neg FROM s"


def sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST(({a}) AS DOUBLE) / ({b}) END"


def sql_metrics() -> str:
    """All of metrics.from_confusion over tp, fp, fn and tn."""
    f1, g1 = sql_ratio("2 * tp", "2 * tp + fp + fn"), sql_ratio("2 * tn", "2 * tn + fp + fn")
    return f"""{sql_ratio("tp + tn", "tp + fp + fn + tn")} AS accuracy, {sql_ratio("tp", "tp + fp")} AS precision, {sql_ratio("tp", "tp + fn")} AS recall, {f1} AS f1,
  {g1} AS f1_mismatch, ({f1} + {g1}) / 2 AS macro_f1, least({f1}, {g1}) AS min_class_f1"""


def sql_best(grid: str, order: str) -> str:
    return f"""WITH {SCORED}, g AS ({HIST}{grid}), {SWEPT}, m AS (SELECT t AS threshold, tp, fp, fn, tn, {sql_metrics()} FROM c)
SELECT * FROM m ORDER BY {order}, abs(threshold - 0.5), threshold LIMIT 1"""


def sql_grid(values: list[float]) -> str:
    return " UNION ALL SELECT unnest([" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values) + "]), 0, 0"


#: The candidate above all scores, at which nothing passes.
ABOVE = " UNION ALL SELECT nextafter(max(score), CAST('inf' AS DOUBLE)), 0, 0 FROM s"
BALANCE = "min_class_f1 DESC, macro_f1 DESC, accuracy DESC"
META = [c for c in text.TEXT_META if c != "num_entities"]


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _count(condition: str) -> str:
    return f"CAST(len(list_filter(l, lambda x: {condition})) AS DOUBLE)"


_NO_NUMBER = r"[^\p{Nd}²³¹⁰⁴⁵⁶⁷⁸⁹₀-₉①-⑨]"


@query(f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents), l AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l FROM t)
SELECT doc_id, CAST(len(w) AS DOUBLE) AS len_words, CAST(length(t) AS DOUBLE) AS len_chars, CAST(length(regexp_replace(t, '{_NO_NUMBER}', '', 'g')) AS DOUBLE) AS num_digits,
  {_count(f"x IN {_in(text.ACTIONS)} OR regexp_matches(x, '(ed|ing|es|ize|ise|ate)$')")} AS num_verbs,
  {_count(f"x NOT IN {_in(text.STOP)} AND length(x) > 3 AND x NOT IN {_in(text.ACTIONS)}")} AS num_nouns,
  CASE WHEN length(regexp_replace(t, '{_NO_NUMBER}', '', 'g')) > 0 THEN 1.0 ELSE 0.0 END AS has_numbers,
  CASE WHEN len(list_filter(l, lambda x: x IN {_in(text.ACTIONS)})) > 0 THEN 1.0 ELSE 0.0 END AS has_actions,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE CAST(length(array_to_string(w, '')) AS DOUBLE) / len(w) END AS sentence_complexity,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE {_count(f"x IN {_in(text.STOP)}")} / len(w) END AS stopword_ratio,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE CAST(len(list_distinct(l)) AS DOUBLE) / len(w) END AS unique_word_ratio
FROM l""")
def text_meta(spark: SparkSession, d: str) -> DataFrame:
    return text.with_text_meta(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", *META)


@query()
def text_entities(spark: SparkSession, d: str) -> DataFrame:
    return text.with_text_meta(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "num_entities")


@query(f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= 0.6) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.6) AS fp,
  count(*) FILTER (WHERE y = 1 AND score < 0.6) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.6) AS tn FROM s)
SELECT tp, fp, fn, tn, {sql_metrics()} FROM c""")
def classwise_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.at_threshold(scored(spark, d), 0.6).select("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "f1_mismatch", "macro_f1", "min_class_f1")


@query(sql_best(sql_grid([0.0, 0.5, 1.0]) + ABOVE, BALANCE))
def balanced_threshold(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.best_balanced(scored(spark, d))


@query(sql_best(sql_grid([0.0, 0.5, 1.0, *thresholds.GRID]), BALANCE))
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.best_balanced_grid(scored(spark, d))


@query(sql_best(sql_grid([0.5, *thresholds.GRID]), "round(f1, 12) DESC"))
def f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.best_f1(scored(spark, d))


@query(f"""WITH {SCORED}, g AS ({HIST}), {SWEPT}, b AS (SELECT *, lag(t) OVER (ORDER BY t) AS before FROM c),
k AS (SELECT CASE WHEN before IS NULL THEN t - 1e-12 ELSE (before + t) / 2 END AS threshold, tp, fp, fn, tn FROM b
  UNION ALL SELECT t + 1e-12, 0, 0, fn + tp, tn + fp FROM (SELECT * FROM c ORDER BY t DESC LIMIT 1)),
m AS (SELECT *, {sql_metrics()} FROM k) SELECT * FROM m ORDER BY f1 DESC, accuracy DESC, abs(threshold - 0.5), threshold LIMIT 1""")
def threshold_midpoints(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.best_midpoint(scored(spark, d))


@query(f"""WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 9) AS roc_auc,
  count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM r""")
def roc_auc_midrank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, d)).withColumn("roc_auc", F.round("roc_auc", 9))


@query(f"""WITH {SCORED}, c AS (SELECT source, count(*) FILTER (WHERE y = 1 AND score >= 0.6) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.6) AS fp,
  count(*) FILTER (WHERE y = 1 AND score < 0.6) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.6) AS tn FROM s GROUP BY ROLLUP(source))
SELECT source, tp, fp, fn, tn, {sql_metrics()} FROM c""")
def metrics_by_domain_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).withColumn("predicted", F.col("score") >= 0.6)
    return metrics.metrics_by_domain(rows, "source").select("source", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "f1_mismatch", "macro_f1", "min_class_f1")


def _bits(a: str, b: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN -({x} / ({a} + {b})) * log2({x} / ({a} + {b})) ELSE 0.0 END"
    return f"({part(a)} + {part(b)})"


@query(f"""WITH l AS (SELECT source, quality AS y FROM documents JOIN labels USING (doc_id)),
t AS (SELECT source, count(*) FILTER (WHERE y = 1) AS m, count(*) FILTER (WHERE y = 0) AS x FROM l GROUP BY source),
a AS (SELECT count(*) AS n_values, sum(m) AS m, sum(x) AS x, sum((m + x) * {_bits("m", "x")}) / (sum(m) + sum(x)) AS h, sum(greatest(m, x)) AS best FROM t),
b AS (SELECT *, {_bits("m", "x")} AS label FROM a)
SELECT 'source' AS field, n_values, round(label, 9) AS label_entropy, round(h, 9) AS conditional_entropy, round(label - h, 9) AS mutual_information,
  round(CASE WHEN label > 0 THEN (label - h) / label ELSE 0.0 END, 9) AS normalized_mutual_information, CAST(best AS DOUBLE) / CAST(m + x AS DOUBLE) AS majority_accuracy FROM b""")
def label_confounding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    out = audit.confounding(rows, "source")
    return out.withColumns({c: F.round(c, 9) for c in ("label_entropy", "conditional_entropy", "mutual_information", "normalized_mutual_information")})


def labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "lang", "source", text.lower_space(F.col("text")).alias("norm"))
    return docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("y")), "sample_id")


NORM = r"regexp_replace(regexp_replace(lower(coalesce(text, '')), '[\s\x0b\x1c-\x1f\x85\pZ]+', ' ', 'g'), '^ | $', '', 'g')"
TEXTS = f"t AS (SELECT doc_id AS sample_id, lang, source, {NORM} AS norm, quality AS y FROM documents JOIN labels USING (doc_id))"
LISTS = "count(*) AS n, array_to_string(list_sort(list(DISTINCT CASE WHEN y = 1 THEN 'match' ELSE 'mismatch' END)), ',') AS labels, array_to_string(list_sort(list(sample_id)), ',') AS sample_ids"


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumns({"labels": F.array_join("labels", ","), "sample_ids": F.array_join(F.col("sample_ids").cast("array<string>"), ",")})


@query(f"WITH {TEXTS} SELECT md5(norm) AS value, {LISTS} FROM t GROUP BY md5(norm) HAVING count(*) >= 2")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return _listed(audit.duplicate_groups(labelled_texts(spark, d).withColumn("value", F.md5("norm")).drop("norm"), "value"))


@query(f"WITH {TEXTS} SELECT sha256(norm) AS text_sha256, length(norm) AS characters, {LISTS}, count(DISTINCT y) > 1 AS opposite FROM t WHERE norm <> '' GROUP BY norm HAVING count(*) >= 2")
def exact_text_groups(spark: SparkSession, d: str) -> DataFrame:
    return _listed(audit.exact_text_groups(labelled_texts(spark, d), "norm")).withColumn("characters", F.col("characters").cast("long"))


@query(f"WITH {TEXTS} SELECT lang, CAST(len(string_split(norm, ' ')) AS INT) AS n_words, {LISTS} FROM t GROUP BY ALL HAVING count(DISTINCT y) > 1")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return _listed(audit.contradictions(labelled_texts(spark, d), [F.col("lang"), F.size(F.split("norm", " ")).alias("n_words")]))


@query("""WITH l AS (SELECT source, quality AS y FROM documents JOIN labels USING (doc_id)),
g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE y = 1) AS m, count(*) FILTER (WHERE y = 0) AS x FROM l GROUP BY source)
SELECT count(*) AS n_groups, coalesce(min(n), 0) AS min_size, coalesce(max(n), 0) AS max_size, coalesce(avg(n), 0.0) AS mean_size, count(*) FILTER (WHERE m > 0) AS support_match,
  count(*) FILTER (WHERE x > 0) AS support_mismatch, least(count(*) FILTER (WHERE m > 0), count(*) FILTER (WHERE x > 0)) AS max_folds FROM g""")
def group_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.group_audit(labelled_texts(spark, d).drop("norm"), "source")


@query("""WITH l AS (SELECT source, quality AS y FROM documents JOIN labels USING (doc_id)),
g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE y = 1) AS match, count(*) FILTER (WHERE y = 0) AS mismatch FROM l GROUP BY source)
SELECT n, match, mismatch, count(*) AS groups FROM g GROUP BY ALL""")
def group_compositions(spark: SparkSession, d: str) -> DataFrame:
    return audit.group_compositions(labelled_texts(spark, d).drop("norm"), "source")


@query(rf"""WITH t AS (SELECT {NORM} AS norm, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1 HAVING norm <> ''),
k AS (SELECT id, copies, list_distinct(regexp_extract_all(norm, '[\pL\pN\pM_]+')) AS s FROM t), u AS (SELECT id, unnest(s) AS tok FROM k),
i AS (SELECT a.id AS l, b.id AS r, count(*) AS c FROM u a JOIN u b ON a.tok = b.tok AND a.id < b.id GROUP BY ALL)
SELECT l AS left_id, r AS right_id, round(c / (len(x.s) + len(y.s) - c), 9) AS jaccard, x.copies AS left_copies, y.copies AS right_copies
FROM i JOIN k x ON x.id = l JOIN k y ON y.id = r WHERE CAST(c AS DOUBLE) / (len(x.s) + len(y.s) - c) >= 0.8
UNION ALL SELECT x.id, y.id, 1.0, x.copies, y.copies FROM k x JOIN k y ON x.id < y.id WHERE len(x.s) = 0 AND len(y.s) = 0""")
def near_dup_jaccard(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.lower_space(F.col("text")).alias("text"))
    return audit.near_jaccard(docs, "text", "doc_id", 0.8).withColumn("jaccard", F.round("jaccard", 9))


@query()
def near_dup_ratio(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.normalize_text("text").alias("text"))
    return audit.near_ratio(docs, "text", "doc_id", 0.95)


def _sql_tokens(c: str) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({c}, '[a-zA-Z][a-zA-Z0-9-]+'), lambda x: lower(x))), lambda x: x NOT IN {_in(text.LABEL_STOP)})"


@query(rf"""WITH b AS (SELECT item_id, text AS ocr, {_sql_tokens("text")} AS b, list_distinct(regexp_extract_all(text, '\p{{Nd}}+(?:[.]\p{{Nd}}+)?')) AS nb FROM benchmark),
a AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, {_sql_tokens("text")} AS a, list_distinct(regexp_extract_all(text, '\p{{Nd}}+(?:[.]\p{{Nd}}+)?')) AS na FROM documents),
j AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0.0 END AS jac FROM a JOIN b USING (item_id))
SELECT doc_id, round(CASE WHEN trim(ocr) = '' THEN 0.5 WHEN len(na) > 0 THEN 0.5 * jac + 0.5 * len(list_intersect(na, nb)) / len(na) ELSE jac END, 9) AS score,
  round(CASE WHEN trim(ocr) = '' THEN 0.0 ELSE 0.35 + 0.65 * least(1.0, (len(a) + len(na)) / 8.0) * least(1.0, (len(b) + len(nb)) / 12.0) END, 9) AS confidence FROM j""")
def caption_alignment(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").count()
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % items).alias("item_id"), text.label_tokens(F.col("text")).alias("a"), text.numbers(F.col("text")).alias("na"))
    read = table(spark, d, "benchmark").select("item_id", F.col("text").alias("ocr"), text.label_tokens(F.col("text")).alias("b"), text.numbers(F.col("text")).alias("nb"))
    out = docs.join(read, "item_id").select("doc_id", text.alignment(*[F.col(c) for c in ("a", "b", "na", "nb", "ocr")]).alias("x"))
    return out.select("doc_id", F.round("x.score", 9).alias("score"), F.round("x.confidence", 9).alias("confidence"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9-]{{2,}}') AS a FROM documents),
u AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS i FROM w),
f AS (SELECT doc_id, lower(raw) AS w, arg_min(raw, i) AS raw FROM u GROUP BY ALL),
k AS (SELECT doc_id, w, length(w) + CASE WHEN regexp_matches(raw, '^[A-Z]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(w, '[-0-9]') THEN 2 ELSE 0 END AS s FROM f
  WHERE w NOT IN {_in(text.NOUN_STOP + text.NOUN_VERBS)} AND NOT (regexp_matches(w, '(ing|ized|ised|ated)$') AND length(w) > 5)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, w) AS r FROM k),
o AS (SELECT doc_id, string_agg(w, ' ' ORDER BY r) AS nouns FROM r WHERE r <= 12 GROUP BY doc_id)
SELECT doc_id, coalesce(nouns, 'diagram scene') AS nouns FROM documents LEFT JOIN o USING (doc_id)""")
def top_nouns(spark: SparkSession, d: str) -> DataFrame:
    return text.with_top_nouns(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.array_join("nouns", " ").alias("nouns"))


def event_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores and router probabilities made of event numbers."""
    e = table(spark, d, "events")
    part = lambda m: ((F.col("event_id") * m) % 101) / 101.0
    cols = {"score_sem": part(7), "score_struct": part(13), "score_obj": part(29), "p_byt": part(3), "p_video": part(5), "p_graph": part(11), "p_scheme": part(17), "has_numbers": (F.col("event_id") % 2).cast("double")}
    return e.select("event_id", *[c.alias(n) for n, c in cols.items()])


_P = ", ".join(f"((event_id * {m}) % 101) / 101.0::DOUBLE AS {n}" for n, m in (("a", 7), ("b", 13), ("c", 29), ("p", 3), ("q", 5), ("r", 11), ("s", 17)))
_SHARE = "-(" + " + ".join(f"CASE WHEN {x} > 0 THEN ({x} / z) * ln(greatest({x} / z, 1e-12)) ELSE 0 END" for x in "pqrs") + ") / ln(4)"


@query(f"""WITH e AS (SELECT event_id, event_id % 2 AS odd, {_P} FROM events), f AS (SELECT *, greatest(p + q + r + s, 1e-12) AS z, (a + b + c) / 3 AS m, list_reverse_sort([p, q, r, s]) AS o FROM e)
SELECT event_id, round(a * (p + q), 9) AS sem_w, round(b * (r + s), 9) AS struct_w, round(c * (s + p), 9) AS obj_w, round(greatest(p, q, r, s), 9) AS router_conf,
  round(abs(a - 0.5), 9) AS sem_margin, round(abs(b - 0.5), 9) AS struct_margin, round(abs(c - 0.5), 9) AS obj_margin, round(m, 9) AS judge_mean,
  round(sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3), 9) AS judge_std, round(greatest(a, b, c) - least(a, b, c), 9) AS judge_range,
  round((abs(a - b) + abs(a - c) + abs(b - c)) / 3, 9) AS judge_disagreement_mean, round({_SHARE}, 9) + 0.0 AS router_entropy, round(o[1] / z - o[2] / z, 9) AS router_margin,
  round(b, 9) AS ocr_text_consistency, round(CASE WHEN odd = 1 THEN b ELSE 0.5 END, 9) AS ocr_numeric_consistency FROM f""")
def router_features(spark: SparkSession, d: str) -> DataFrame:
    rows = features.add_features(event_scores(spark, d))
    return rows.select("event_id", *[F.round(c, 9).alias(c) for c in [*features.WEIGHTED, *features.DERIVED]])


@query("""WITH t AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS claim, generate_subscripts(l, 1) AS claim_id FROM t)
SELECT doc_id, CAST(claim_id AS INT) AS claim_id, doc_id || '#' || claim_id AS id, md5(regexp_replace(claim, '^ +| +$', '', 'g')) AS claim_md5 FROM u""")
def claims_explode(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    listed = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    docs = table(spark, d, "documents").select("doc_id", listed.alias("list")).where("list != ''")
    rows = docs.select("doc_id", F.posexplode(text.claims(F.col("list"))).alias("i", "claim")).withColumn("claim_id", F.col("i") + 1)
    return rows.select("doc_id", "claim_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("claim_id").cast("string")).alias("id"), F.md5("claim").alias("claim_md5"))


PROMPTS = [
    ("a photo of a cat", "single_object", "cat", "", "supported"), ("A photo of two dogs.", "counting", "dog", "2", "supported"),
    ("a photo of a red bus", "colors", "bus", "red", "supported"), ("a photo of a dog and a cat", "two_object", "dog|cat", "", "supported"),
    ("a photo of a cup left of a fork", "position", "fork|cup", "left of", "supported"), ("a photo of a cup above a rock", "", "", "", "unsupported_position_objects"),
    ("a photo of three rocks", "", "", "", "unsupported_count_object"), ("a photo of a red rock", "", "", "", "unsupported_colored_object"),
    ("a photo of a dog and a rock", "", "", "", "unsupported_two_object_prompt"), ("a photo of a dog and a cat and a cup", "", "", "", "more_than_two_objects"),
    ("a photo of a rock", "", "", "", "not_in_geneval_coco_vocabulary"), ("figure 3 shows a cat", "", "", "", "not_a_simple_photo_prompt"),
]


@query("SELECT p_partkey, prompt, tag, objects, detail, reason FROM part, (VALUES " + ", ".join(f"({i}, {', '.join(repr(x) for x in row)})" for i, row in enumerate(PROMPTS)) + f") AS v(i, prompt, tag, objects, detail, reason) WHERE p_partkey % {len(PROMPTS)} = i")
def template_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.element_at(F.array(*[F.lit(p[0]) for p in PROMPTS]), (F.col("p_partkey") % len(PROMPTS) + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", prompt.alias("prompt")).withColumn("t", text.prompt_template(F.col("prompt")))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("p_partkey", "prompt", blank(F.col("t.tag")).alias("tag"), F.array_join("t.objects", "|").alias("objects"), blank(F.col("t.detail")).alias("detail"), F.col("t.reason").alias("reason"))


@query(f"""WITH p AS (SELECT p_partkey % {len(PROMPTS)} AS i FROM part), v AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{row[4]}')" for i, row in enumerate(PROMPTS)) + """) AS v(i, reason))
SELECT reason, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM p JOIN v USING (i) GROUP BY reason""")
def template_coverage(spark: SparkSession, d: str) -> DataFrame:
    counts = template_prompts(spark, d).groupBy("reason").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each reason


@query(rf"""WITH q AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\*+', '', 'g'), '[“”]', '"', 'g') AS q FROM conversations),
r AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(replace(q, '’', ''''), '\\[a-zA-Z]+', ' ', 'g'), '[{{}}$\\()\[\]]', ' ', 'g'), '[\s\x0b\x1c-\x1f\x85\pZ]+', ' ', 'g') AS q FROM q),
s AS (SELECT conv_id, turn, regexp_replace(regexp_replace(q, '^ | $', '', 'g'), '^[ \t"''`.,;:]+|[ \t"''`.,;:]+$', '', 'g') AS q FROM r),
n AS (SELECT conv_id, turn, substr(array_to_string(list_slice(string_split(q, ' '), 1, 8), ' '), 1, 80) AS query FROM s)
SELECT conv_id, turn, query, CASE WHEN lower(query) IN {_in(text.ATTRIBUTES)} THEN 'attr' WHEN regexp_matches(lower(query), '{"|".join(text.OBJECT_WORDS)}') THEN 'object'
  WHEN len(string_split(query, ' ')) >= 4 OR regexp_matches(query, '^\p{{Ll}}') THEN 'text' ELSE 'region' END AS kind FROM n""")
def query_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.normal_query(F.col("text")).alias("query"))
    return rows.withColumn("kind", text.guess_kind(F.col("query")))


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def unlabelled_docs(spark: SparkSession, d: str) -> DataFrame:
    return matching.remaining(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("""SELECT u.conv_id, u.turn, length(u.text) AS orig_size, length(a.text) AS fail_size, length(u.text) = length(a.text) AND md5(u.text) = md5(a.text) AS same_bytes
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'""")
def paired_twins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumns({"size": F.length("text").cast("long"), "digest": F.md5("text")})
    user = c.where("role = 'user'").select("conv_id", "turn", "size", "digest")
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "size", "digest")
    return matching.collect_pairs(user, reply, ["conv_id", "turn"], "size", "digest").select("conv_id", "turn", "orig_size", "fail_size", "same_bytes")


@query("""SELECT 'text' AS kind, md5(text) AS value FROM documents INTERSECT SELECT 'text', md5(text) FROM benchmark
UNION ALL (SELECT 'line', md5(l) FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) INTERSECT SELECT 'line', md5(l) FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark))""")
def leakage_guard(spark: SparkSession, d: str) -> DataFrame:
    docs, bench = table(spark, d, "documents").select("text"), table(spark, d, "benchmark").select("text")
    lines = lambda df: df.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return matching.leaks(docs, bench, {"text": F.md5("text")}).unionByName(matching.leaks(lines(docs), lines(bench), {"line": F.md5("line")}))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_record_wins(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    users = log.select("user_id").distinct()
    return matching.in_expected_order(users, log, "user_id", "event_id").select("user_id", "record.event_id", "record.event_type", "record.value")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_preferred(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return matching.first_preferred(rows, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")])


@query("""WITH l AS (SELECT doc_id, quality AS y FROM labels), c AS (SELECT floor(count(*) FILTER (WHERE y = 0) * 3.0) AS cap FROM l),
r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM l)
SELECT doc_id, y FROM r, c WHERE y = 0 OR r <= cap""")
def class_cap(spark: SparkSession, d: str) -> DataFrame:
    return splits.class_cap(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "y", "doc_id")


@query("""WITH e AS (SELECT user_id, event_type AS v, event_id AS o FROM events), f AS (SELECT user_id, v, min(o) AS o FROM e GROUP BY ALL),
p AS (SELECT user_id, string_agg(v, '; ' ORDER BY o) AS lie, count(*) AS n FROM f GROUP BY user_id) SELECT user_id, lie, n FROM p""")
def ordered_distinct_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("object"), F.col("event_type").alias("lie"))
    return matching.merge_reasons(rows, ["user_id"], "event_id").select("user_id", "lie", F.size("objects").cast("long").alias("n"))


@query("""WITH p AS (SELECT a.vec_id, a.label, list_transform(list_zip(a.embedding, b.embedding), lambda x: [x[1]::DOUBLE, x[2]::DOUBLE]) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0),
m AS (SELECT vec_id, label, sqrt(list_sum(list_transform(z, lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS l2, list_sum(list_transform(z, lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(z, lambda x: x[1] * x[1]))) * sqrt(list_sum(list_transform(z, lambda x: x[2] * x[2])))) AS cosine FROM p)
SELECT label, count(*) AS n, round(avg(l2), 4) AS mean_l2, round(max(l2), 4) AS max_l2, round(avg(cosine), 4) AS mean_cosine FROM m GROUP BY label""")
def embedding_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    a = e.where("vec_id % 2 = 0").select("vec_id", "label", F.col("embedding").alias("u"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v"))
    pairs = a.join(b, "vec_id").select("label", features.l2(F.col("u"), F.col("v")).alias("l2"), features.cosine(F.col("u"), F.col("v")).alias("cosine"))
    return pairs.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("l2"), 4).alias("mean_l2"), F.round(F.max("l2"), 4).alias("max_l2"), F.round(F.avg("cosine"), 4).alias("mean_cosine"))


@query(f"""WITH {SCORED}, g AS (SELECT source, avg(score) FILTER (WHERE y >= 0.5) AS p, avg(score) FILTER (WHERE y < 0.5) AS n FROM s GROUP BY source)
SELECT round(coalesce(avg(greatest(0.0, 0.2 - p + n)), 0.0), 9) AS loss, count(*) AS n_groups FROM g WHERE p IS NOT NULL AND n IS NOT NULL""")
def pair_hinge(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pair_hinge(scored(spark, d), "source", logit="score").withColumn("loss", F.round("loss", 9))


@query("""WITH w AS (SELECT DISTINCT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations),
u AS (SELECT conv_id, w FROM w WHERE role = 'user'), a AS (SELECT conv_id, w FROM w WHERE role = 'assistant'),
c AS (SELECT count(*) FILTER (WHERE u.w IS NOT NULL AND a.w IS NOT NULL) AS tp, count(*) FILTER (WHERE a.w IS NULL) AS fp, count(*) FILTER (WHERE u.w IS NULL) AS fn FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.w = a.w)
SELECT tp, fp, fn, CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c""")
def graph_prf(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return metrics.bag_counts(words.where("role = 'user'"), words.where("role = 'assistant'"), ["conv_id", "w"])


@query("""SELECT conv_id, turn, 'system' AS first_role, 2 AS n, 'Claim:' || chr(10) || regexp_replace(text, '^ +| +$', '', 'g') AS asked FROM conversations WHERE role = 'user'""")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'").withColumn("m", graphs.chat_messages(F.col("text"), system="Reply with a scene graph."))
    return rows.select("conv_id", "turn", F.element_at("m", 1)["role"].alias("first_role"), F.size("m").alias("n"), F.element_at("m", -1)["content"].alias("asked"))


@query("""WITH t AS (SELECT DISTINCT p_brand AS tree FROM part WHERE p_brand IS NOT NULL), l AS (SELECT DISTINCT p_type AS linear FROM part WHERE p_type IS NOT NULL),
w AS (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS weight)
SELECT tree, linear, weight, 'ensemble_' || tree || '_' || linear || '_xgb' || weight AS name, row_number() OVER (ORDER BY weight DESC, tree DESC, linear DESC) AS rank FROM t, l, w""")
def ensemble_grid(spark: SparkSession, d: str) -> DataFrame:
    """Brands stand for tree models, types for linear ones."""
    from pairlens.operators.models import WEIGHTS

    named = lambda c: table(spark, d, "part").where(F.col(c).isNotNull()).select(F.col(c).alias("name")).distinct()
    grid = matching.tree_linear_grid(named("p_brand"), named("p_type"), WEIGHTS)
    return matching.rank_candidates(grid, ["weight", "tree", "linear"]).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id, regexp_replace(lang || CASE WHEN doc_id % 2 = 0 THEN '_orig' ELSE '_l2_fail' END || '/' || source || '/' || doc_id, '^([^/]*?)(_l2_fail|_orig)/', '\\1/') AS pair_group, lang AS domain, doc_id % 2 = 1 AS fail FROM documents")
def pair_keys(spark: SparkSession, d: str) -> DataFrame:
    sid = F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "_orig").otherwise("_l2_fail"), F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").select("doc_id", sid.alias("sample_id"))
    return rows.select("doc_id", keys.pair_group(F.col("sample_id"), "raise").alias("pair_group"), keys.domain_of_id(F.col("sample_id")).alias("domain"), keys.is_fail_split(F.split_part("sample_id", F.lit("/"), F.lit(1))).alias("fail"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN rank <= least(CASE WHEN n >= 5 THEN greatest(1, CAST(round_even(n * 0.15, 0) AS INT)) ELSE CAST(round_even(n * 0.15, 0) AS INT) END, n - 1) THEN 'val' ELSE 'train' END AS split FROM r""")
def figure_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.figure_split(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source").select("doc_id", "source", "split")


@query("SELECT source, sha256(string_agg(doc_id, chr(10) ORDER BY doc_id)) AS fingerprint, count(*) AS n FROM documents GROUP BY source")
def split_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_fingerprint(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "doc_id", ["source"])


@query("""SELECT item_id, sha256(CAST(to_json({caption: text, image: item_id || '.png', model: 'm', protocol: 'p', sample_id: CAST(item_id AS VARCHAR)}) AS VARCHAR)) AS record_key FROM benchmark""")
def record_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark")
    sid = F.col("item_id").cast("string")
    return rows.select("item_id", jsontools.record_key(sid, F.concat(sid, F.lit(".png")), F.col("text"), F.lit("m"), F.lit("p")).alias("record_key"))


@query(f"""WITH {SCORED} SELECT round(avg(score) FILTER (WHERE y = 1), 9) AS mean_match, round(avg(score) FILTER (WHERE y = 0), 9) AS mean_mismatch,
  round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE y = 1), 9) AS match_above_half, round(avg(CASE WHEN score < 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE y = 0), 9) AS mismatch_below_half,
  round(avg(score) FILTER (WHERE y = 1) - avg(score) FILTER (WHERE y = 0), 9) AS margin FROM s""")
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.split_summary(scored(spark, d))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query()
def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_texts(spark, d).select("y", F.concat_ws("/", "source", "lang").alias("grp"))
    return audit.fold_assignment(rows, "grp", 5)


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).withColumn("predicted", F.col("score") >= 0.6)
    return bootstrap.confidence_intervals(rows)


@query()
def judge_json(spark: SparkSession, d: str) -> DataFrame:
    """Turns as answers in the forms that judges give, their lines as what was right or wrong, parsed and counted."""
    lines = F.to_json(F.split(F.coalesce("text", F.lit("")), "\n"))
    say = lambda *x: F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in x])
    forms = [
        say('{"verdict": "Pass.", "correct_things": ', lines, "}"), say('```json\n{"verdict": "regenerate", "mistake_things": ', lines, "}\n```"), say(F.col("text"), " {'verdict': 'pass', 'critical thinks': []} ", F.col("text")),
        say('{"verdict": ', F.to_json(F.array("text")), "}"), F.col("text"), say('{"a": "}{", "b": ', lines, ', "verdict": "PASS"} tail'),
    ]
    raw = F.get(F.array(*forms), (F.col("turn") % len(forms)).cast("int"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", jsontools.parse_answer(raw).alias("r"))
    return rows.select("conv_id", "turn", F.col("r.parsed.verdict").alias("verdict"), F.size("r.parsed.correct_things").alias("n_correct"), F.col("r.error").alias("error"))


@query()
def claim_graph(spark: SparkSession, d: str) -> DataFrame:
    claim = F.concat(F.lit("A fire symbol on the Encoder identifies it as trained, while the "), F.col("text"), F.lit(" is to the left of the Decoder."))
    # rules are slow and files are few: rows are spread evenly, several tasks a core
    spread = table(spark, d, "conversations").select("conv_id", "turn", claim.alias("claim")).repartition(4 * spark.sparkContext.defaultParallelism)
    rows = spread.transform(lambda df: claimgraph.with_graphs(df, "claim", "g"))
    return rows.select("conv_id", "turn", F.size("g.nodes").alias("nodes"), F.size("g.edges").alias("edges"), graphs.dump_graph(F.col("g")).alias("graph"))


@query()
def arbiter_cv(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of one candidate of each family and their ensembles, ranked."""
    from pairlens.operators import models

    rows = scored(spark, d).withColumns({"grp": F.concat_ws("/", "source", "lang"), "half": F.abs(F.col("score") - 0.5), "square": F.col("score") * F.col("score")})
    folds = splits.repeated_folds(rows, "grp", 1, 3)
    chosen = [models.Candidate("logreg_C1", "logistic", {"C": 1.0}), models.Candidate("xgb_00", "trees", {"trees": 5, "depth": 2, "step": 0.3, "leaf": 3, "rows": 0.8, "columns": 1.0})]
    oof = models.out_of_fold(rows, folds, "grp", "doc_id", ["score", "half", "square"], chosen)
    grid = spark.createDataFrame([("mix", "xgb_00", "logreg_C1", 0.5)], "name string, tree string, linear string, weight double")
    both = oof.unionByName(models.ensembles(oof, grid, "doc_id"))
    return models.select_candidates(both, "doc_id").select("candidate", "threshold", "min_class_f1", "macro_f1", "accuracy", "f1")


@query()
def resume_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream that is worked on once each, then read back by key."""
    from pairlens.sources import storage
    from pairlens.streaming import resume

    here = storage.new_path(spark, "stream")
    events = table(spark, d, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").select(F.col("event_id").cast("string").alias("record_key"), F.col("event_id").alias("ordinal"), "event_type", "value")
    resume.stream(source, lambda df: df.withColumn("score", F.col("value") * 2), f"{here}/log", f"{here}/checkpoint").awaitTermination()
    return resume.read_log(spark, f"{here}/log").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


#: Unicode's white space, for expressions that know only ASCII's.
BLANK = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{BLANK}+', ' ', 'g')")


IDS = """i AS (SELECT doc_id, source, lang, source || CASE doc_id % 3 WHEN 0 THEN '_l2_fail' WHEN 1 THEN '_orig' ELSE '' END AS split,
  CASE WHEN doc_id % 11 = 0 THEN 'golden/' ELSE '' END || source || CASE doc_id % 3 WHEN 0 THEN '_l2_fail' WHEN 1 THEN '_orig' ELSE '' END || '/document_' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '/fig' || (doc_id % 7) || '.png' END AS sid FROM documents)"""


def ids(spark: SparkSession, d: str) -> DataFrame:
    """Documents as members of splits, with ids like those of figures."""
    split = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "_l2_fail").when(F.col("doc_id") % 3 == 1, "_orig").otherwise(""))
    sid = F.concat(F.when(F.col("doc_id") % 11 == 0, "golden/").otherwise(""), split, F.lit("/document_"), "doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("/fig"), F.col("doc_id") % 7, F.lit(".png"))))
    return table(spark, d, "documents").select("doc_id", "source", "lang", split.alias("split"), sid.alias("sid"))


@query(f"""WITH {IDS}, p AS (SELECT *, string_split(sid, '/') AS parts, regexp_replace(sid, '^([^/]*?)(?:_l2_fail|_orig)(/|$)', '\\1\\2') AS stripped,
  regexp_replace(CASE WHEN doc_id % 2 = 0 THEN replace(sid, '/', chr(92)) ELSE sid END, '^.*[/\\\\]|\\.[^./]*$', '', 'g') AS file,
  regexp_replace(sid, '^.*/|\\.[^./]*$', '', 'g') AS stem FROM i)
SELECT doc_id, stripped AS strip_group, CASE WHEN len(parts) >= 3 THEN stripped ELSE sid END AS keep_group,
  array_to_string(list_transform(parts, lambda s: regexp_replace(s, '(?:_l2_fail|_orig)$', '')), '/') AS source_group,
  regexp_replace(split, '(?:_l2_fail|_orig)$', '') AS domain, regexp_replace(parts[1], '(?:_l2_fail|_orig)$', '') AS id_domain, replace(replace(split, '_l2_fail', ''), '_orig', '') AS family,
  replace(replace(split, '_l2_fail', ''), '_orig', '') || '/' || lang || '/' || sid AS figure_key, contains(lower(split), 'l2_fail') AS fails, list_contains(string_split(lower(sid), '/'), 'golden') AS holdout,
  CASE WHEN doc_id % 4 = 0 THEN 'row-' || doc_id WHEN doc_id % 4 = 1 THEN lang ELSE sid END AS sample_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE sid END AS image,
  CASE WHEN starts_with(stem, 'document_') THEN stem END AS document,
  CASE WHEN parts[1] = 'golden' AND len(parts) >= 4 THEN 'golden/' || parts[2] || '/' || parts[3] || '/' || regexp_replace(parts[-1], '\\.[^.]*$', '')
    WHEN parts[1] LIKE '%\\_orig' ESCAPE '\\' AND len(parts) >= 3 THEN parts[1] || '/' || parts[2] || '/' || regexp_replace(parts[-1], '\\.[^.]*$', '') END AS annotation,
  regexp_replace(sid, '^((?:golden/)?[^/]*?)_orig(/)', '\\1_l2_fail\\2') AS fail_key,
  CASE WHEN (doc_id % 10) / 10.0 >= 0.5 THEN 'PASS' ELSE 'REGENERATE' END AS verdict, CASE WHEN (doc_id % 10) / 10.0 >= 0.5 THEN 'match' ELSE 'mismatch' END AS label,
  CASE doc_id % 4 WHEN 0 THEN doc_id % 8 = 0 WHEN 1 THEN false WHEN 2 THEN true ELSE doc_id % 2 = 0 END AS target FROM p""")
def record_fields(spark: SparkSession, d: str) -> DataFrame:
    c, n = F.col, F.lit(None).cast("string")
    by4 = c("doc_id") % 4
    word = F.when(by4 == 1, "Regenerate").when(by4 == 2, "PASS")
    sure = keys.verdict((c("doc_id") % 10) / 10.0)
    return ids(spark, d).select(
        "doc_id", keys.pair_group(c("sid")).alias("strip_group"), keys.pair_group(c("sid"), "keep").alias("keep_group"), keys.source_group(n, F.when(c("doc_id") % 2 == 0, F.replace("sid", F.lit("/"), F.lit("\\"))), c("sid")).alias("source_group"),
        keys.domain_of(c("split")).alias("domain"), keys.domain_of_id(c("sid")).alias("id_domain"), keys.family_of(c("split")).alias("family"), keys.figure_key(c("split"), c("lang"), c("sid")).alias("figure_key"),
        keys.is_fail_split(c("split")).alias("fails"), keys.is_holdout(c("split"), c("sid")).alias("holdout"),
        keys.sample_id_of(F.when(by4 >= 2, c("sid")).when(by4 == 1, ""), F.when(by4 == 1, c("lang")), c("doc_id")).alias("sample_id"), keys.image_of(F.when(c("doc_id") % 2 == 1, c("sid")).otherwise(""), c("lang")).alias("image"),
        keys.document_id(n, c("sid")).alias("document"), keys.annotation_key(c("sid")).alias("annotation"), keys.fail_key(c("sid")).alias("fail_key"), sure["verdict"].alias("verdict"), sure["label"].alias("label"),
        keys.is_match(word, F.when(by4 == 0, c("doc_id") % 8 != 0), None, (c("doc_id") % 2).cast("int")).alias("target"),
    )


FIGURE = r"(?i)(?:fig(?:ure)?\.?[\x09-\x0D\x20]*[0-9]+[a-z]?)[\x09-\x0D\x20]*[:.\-–—]?[\x09-\x0D\x20]*[^\n.!?]{8,200}"


@query(f"""WITH b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '  ' || source || ' ' WHEN 1 THEN '' END AS caption, CASE WHEN doc_id % 3 > 0 THEN text END AS block, CASE WHEN doc_id % 2 = 0 THEN text || '  ' ELSE '' END AS premise FROM documents),
c AS (SELECT *, {_strip("coalesce(caption, '')")} AS cap, {_strip("coalesce(block, '')")} AS bl, {_strip("coalesce(nullif(block, ''), nullif(premise, ''), '')")} AS blob FROM b),
f AS (SELECT *, {_squeeze(f"regexp_extract(blob, '{FIGURE}')")} AS figure, {_squeeze("CASE WHEN regexp_matches(blob, '[.!?][\\x09-\\x0D\\x20]') THEN regexp_extract(blob, '(?s)^(.*?[.!?])[\\x09-\\x0D\\x20]', 1) ELSE blob END")} AS sentence FROM c)
SELECT doc_id, {_strip("coalesce(nullif(premise, ''), nullif(bl, ''), nullif(cap, ''), '')")} AS premise, {_strip("coalesce(nullif(caption, ''), nullif(premise, ''), nullif(block, ''), '')")} AS caption,
  left(CASE WHEN cap <> '' THEN cap WHEN figure <> '' THEN figure ELSE sentence END, 280) AS short FROM f""")
def caption_forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.when(n % 4 == 0, F.concat(F.lit("  "), "source", F.lit(" "))).when(n % 4 == 1, "").alias("caption"), F.when(n % 3 > 0, F.col("text")).alias("block"), F.when(n % 2 == 0, F.concat("text", F.lit("  "))).otherwise("").alias("premise"))
    c, b, p = F.col("caption"), F.col("block"), F.col("premise")
    return rows.select("doc_id", keys.premise_of(c, b, p).alias("premise"), keys.caption_of(c, p, b).alias("caption"), keys.short_caption(c, b, p).alias("short"))


@query(f"""WITH r AS (SELECT doc_id, {_strip("lower(CASE doc_id % 4 WHEN 0 THEN ' Figure ' || doc_id || ' С' WHEN 1 THEN 'FIGURE' || doc_id WHEN 2 THEN 'Graphical аbstract' ELSE text END)")} AS low,
  CASE doc_id % 3 WHEN 0 THEN '[[' || doc_id || '.5, 2]]' WHEN 1 THEN ' -' || doc_id || 'e-1' ELSE 'none' END AS raw, text FROM documents),
t AS (SELECT *, translate(low, 'асеорху', 'aceopxy') AS r FROM r), g AS (SELECT *, contains(r, 'graphical') AND contains(r, 'abstract') AS graphical FROM t)
SELECT doc_id, graphical, CASE WHEN NOT graphical THEN nullif(regexp_extract(r, 'figure[\\x09-\\x0D\\x20]*([0-9]+)[\\x09-\\x0D\\x20]*([a-z])?', 1), '') END AS number,
  CASE WHEN NOT graphical THEN nullif(regexp_extract(r, 'figure[\\x09-\\x0D\\x20]*([0-9]+)[\\x09-\\x0D\\x20]*([a-z])?', 2), '') END AS panel,
  TRY_CAST(nullif(regexp_extract(raw, '^[\\[\\x09-\\x0D\\x20]*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)', 1), '') AS DOUBLE) AS score, {_squeeze("lower(coalesce(text, ''))")} AS spaced FROM g""")
def references(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    ref = F.when(n % 4 == 0, F.concat(F.lit(" Figure "), n, F.lit(" С"))).when(n % 4 == 1, F.concat(F.lit("FIGURE"), n)).when(n % 4 == 2, "Graphical аbstract").otherwise(F.col("text"))
    raw = F.when(n % 3 == 0, F.concat(F.lit("[["), n, F.lit(".5, 2]]"))).when(n % 3 == 1, F.concat(F.lit(" -"), n, F.lit("e-1"))).otherwise("none")
    rows = table(spark, d, "documents").select("doc_id", text.figure_ref(ref).alias("f"), jsontools.score_value(raw).alias("score"), text.lower_space(F.col("text")).alias("spaced"))
    return rows.select("doc_id", "f.graphical", "f.number", "f.panel", "score", "spaced")


@query(f"""WITH {SCORED}, m AS (SELECT source, sum(CASE WHEN y = 1 AND score >= 0.6 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND score >= 0.6 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND score < 0.6 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND score < 0.6 THEN 1 ELSE 0 END) AS tn FROM s GROUP BY source),
v AS (SELECT source, (tp + tn) / (tp + fp + fn + tn) AS accuracy, {sql_ratio("2 * tp", "2 * tp + fp + fn")} AS f1, {sql_ratio("2 * tn", "2 * tn + fp + fn")} AS f0 FROM m),
u AS (SELECT unnest(['accuracy', 'macro_f1', 'min_class_f1', 'f1', 'f1_mismatch']) AS metric, unnest([accuracy, (f1 + f0) / 2, least(f1, f0), f1, f0]) AS v FROM v)
SELECT metric, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, round(min(v), 9) AS min, round(max(v), 9) AS max FROM u GROUP BY metric""")
def stability(spark: SparkSession, d: str) -> DataFrame:
    """How far metrics differ between sources, as between folds."""
    rows = scored(spark, d).withColumn("p", F.col("score") >= 0.6)
    y, p = F.col("y") == 1, F.col("p")
    by = rows.groupBy("source").agg(*[F.sum(c.cast("long")).alias(k) for k, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))]).withColumns(metrics.from_confusion())
    out = bootstrap.stability(by)
    return out.select("metric", *[F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max")])


@query(f"""WITH {IDS}, o AS (SELECT doc_id, lang, sid, doc_id % 50 AS k FROM i WHERE doc_id % 3 = 1), f AS (SELECT DISTINCT lang, doc_id % 50 AS k FROM i WHERE doc_id % 3 = 0 AND doc_id % 2 = 0)
SELECT lang, k, arg_min(sid, doc_id) AS sid FROM o ANTI JOIN f USING (lang, k) GROUP BY lang, k""")
def lone_originals(spark: SparkSession, d: str) -> DataFrame:
    rows, n = ids(spark, d).withColumn("k", F.col("doc_id") % 50), F.col("doc_id")
    return matching.originals_alone(rows.where(n % 3 == 1), rows.where((n % 3 == 0) & (n % 2 == 0)), ["lang", "k"], [n]).select("lang", "k", "sid")


@query("""WITH f AS (SELECT doc_id % 200 AS k, source AS root, lang || '/' || doc_id AS path FROM documents WHERE doc_id % 3 > 0), r AS (SELECT DISTINCT source FROM documents),
o AS (SELECT source AS root, row_number() OVER (ORDER BY source DESC) AS rank FROM r), b AS (SELECT k, arg_min(path, (rank, path)) AS first_root FROM f JOIN o USING (root) GROUP BY k),
q AS (SELECT doc_id, doc_id % 200 AS k, ['de/' || (doc_id - 1), 'fr/' || doc_id, lang || '/' || doc_id] AS tried FROM documents), files AS (SELECT DISTINCT path FROM f),
t AS (SELECT doc_id, unnest(tried) AS path, generate_subscripts(tried, 1) AS i FROM q), h AS (SELECT doc_id, arg_min(path, i) AS resolved FROM t JOIN files USING (path) GROUP BY doc_id)
SELECT q.doc_id, first_root, resolved FROM q LEFT JOIN b USING (k) LEFT JOIN h USING (doc_id)""")
def resolved_files(spark: SparkSession, d: str) -> DataFrame:
    """Files by the first root that has their key, and by the first candidate path that exists."""
    docs = table(spark, d, "documents").withColumn("k", F.col("doc_id") % 200)
    roots = sorted((r.source for r in docs.select("source").distinct().collect()), reverse=True)  # a few names
    files = docs.where("doc_id % 3 > 0").select("k", F.col("source").alias("root"), F.concat_ws("/", "lang", "doc_id").alias("path"))
    one = matching.first_preferred(files, ["k", "root"], [F.col("path")])
    tried = F.array(F.concat(F.lit("de/"), F.col("doc_id") - 1), F.concat(F.lit("fr/"), "doc_id"), F.concat_ws("/", "lang", "doc_id"))
    found = matching.first_root(docs.select("doc_id", "k", "lang"), one, "k", "root", roots).withColumnRenamed("resolved", "first_root")
    return matching.resolve(found, tried, files, "doc_id").select("doc_id", "first_root", "resolved")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of labelled documents at the best balanced threshold of their score."""
    return thresholds.best_balanced(scored(spark, d))


