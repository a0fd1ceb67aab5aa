"""More queries by name: scorers, searches over models, stateful streams, logs, growing tables, and the audit as a whole.

Importing this module adds them to those of plans.queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions import features, nested, scorers, text
from pairlens.operators import audit, bootstrap, matching, metrics, splits, thresholds
from pairlens.plans.queries import ABOVE, BALANCE, META, NORM, SCORED, SQL, TEXTS, _bits, labelled_texts, query, scored, sql_best, sql_metrics, table
from pairlens.sources import jsonlog, storage

#: Weights of the text features for the linear score of a document.
LINEAR = scorers.Linear(dict(zip(META, [0.002, -0.0001, 0.01, 0.02, 0.01, 0.3, -0.2, 0.05, 1.5, 1.0], strict=True)), -1.2)


@query(f"""WITH m AS ({SQL["text_meta"]}), s AS (SELECT doc_id, len_words, 1 / (1 + exp(-({" + ".join(f"{c} * {w!r}" for c, w in LINEAR.weights.items())} + {LINEAR.bias!r}))) AS score FROM m)
SELECT doc_id, round(score, 9) AS score, round(abs(2 * score - 1) * least(1.0, len_words / {LINEAR.full_evidence!r}), 9) AS confidence FROM s""")
def linear_scorer(spark: SparkSession, d: str) -> DataFrame:
    """A document's linear score from its text features, and the confidence in it, in Arrow batches with weights that a worker loads once."""
    rows = text.with_text_meta(table(spark, d, "documents").select("doc_id", "text"))
    score = scorers.batch_scorer(LINEAR.scorer(spark))
    out = rows.select("doc_id", F.array(*META).alias("x"), "len_words").select("doc_id", score("x", "len_words").alias("s"))
    return out.select("doc_id", F.round("s.score", 9).alias("score"), F.round("s.confidence", 9).alias("confidence"))


def _model_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Labelled documents with their text features; groups are source and first word."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    first = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), text.WORDS, 0))
    rows = rows.select("doc_id", "y", "text", F.concat_ws("/", "source", first).alias("grp"))
    return text.with_text_meta(rows).select("doc_id", "y", "grp", *META), META


@query()
def logistic_search(spark: SparkSession, d: str) -> DataFrame:
    """Seven penalties on five repeats of five grouped folds, all 175 models trained at once, ranked by their out-of-fold scores."""
    from pairlens.operators import models, search

    rows, names = _model_rows(spark, d)
    rows = rows.persist()  # texts are read once, for folds and features
    folds = splits.repeated_folds(rows, "grp", 5, 5)
    data = search.prepare(rows, folds, "grp", "doc_id", names).persist()
    candidates = [c for c in models.base_candidates() if c.family == "logistic"]
    found = search.Search(data, candidates, 5, 5, names)
    return models.select_candidates(found.mean_scores("doc_id"), "doc_id").select("candidate", *[F.round(c, 6).alias(c) for c in ("threshold", "min_class_f1", "macro_f1", "accuracy", "f1")])


@query()
def tree_attributions(spark: SparkSession, d: str) -> DataFrame:
    """How far each text feature moves the margin of boosted trees, over all labelled documents."""
    from pyspark.ml.functions import vector_to_array

    from pairlens.operators import attributions, models

    rows, names = _model_rows(spark, d)
    model = models.fit(models.Candidate("trees", "trees", {"trees": 10, "depth": 3, "step": 0.1, "leaf": 3, "rows": 1.0, "columns": 1.0}), rows, names)
    scaled = model.transform(rows).select("doc_id", vector_to_array("__scaled").alias("x"))
    leaves = attributions.of_model(model.stages[-1], storage.new_path(spark, "trees"))
    return attributions.summary(attributions.attribute(scaled, leaves, F.col("x"), len(names)), names)


@query("""SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def last_event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event, by a stream that keeps no more of a user than the number of the last one."""
    from pairlens.streaming import keyed

    here = storage.new_path(spark, "keyed")
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select("user_id", "event_id", "event_type", "value")
    keyed.start(keyed.latest(events, "user_id", "event_id"), f"{here}/log", f"{here}/checkpoint", lambda df: df.drop("__first")).awaitTermination()
    return keyed.read_log(spark, f"{here}/log", "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, round(sum(value), 4) AS total, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY event_type""")
def durable_log(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a log of JSON lines in two commits and read back by ranges of bytes."""
    log = storage.new_path(spark, "log")
    events = table(spark, d, "events").select("event_id", "event_type", "value", "props")
    jsonlog.append(events.where("event_id % 2 = 0"), log)
    jsonlog.append(events.where("event_id % 2 = 1"), log)
    rows = jsonlog.read(spark, log, "event_id long, event_type string, value double, props string", 1 << 18)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"), F.round(F.sum("value"), 4).alias("total"), F.sum(F.length("props")).alias("chars"))


GROUPED = f"""{SCORED}, g AS (SELECT source || '/' || lang AS grp, count(*) FILTER (WHERE y = 1 AND score >= 0.6) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.6) AS fp,
  count(*) FILTER (WHERE y = 1 AND score < 0.6) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.6) AS tn FROM s GROUP BY 1)"""


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(F.concat_ws("/", "source", "lang").alias("grp"), "y", (F.col("score") >= 0.6).alias("predicted"))


@query(f"WITH {GROUPED} SELECT tp, fp, fn, tn, count(*) AS groups FROM g GROUP BY ALL")
def confusion_compositions(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.compositions(_grouped(spark, d), "grp")


@query()
def group_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals when whole groups are drawn, each replicate as many groups as there are."""
    return bootstrap.group_intervals(_grouped(spark, d), "grp")


@query(f"""WITH m AS ({SQL["text_meta"]}) SELECT doc_id, CASE WHEN quality = 1 THEN 'match' ELSE 'mismatch' END AS label, CAST(quality AS INTEGER) AS y, {", ".join(f"round({c}, 9) AS {c}" for c in META)} FROM labels JOIN m USING (doc_id)""")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Text features of labelled documents from a matrix that first knew half of them and then computed only the rest."""
    from pairlens.operators.matrix import FeatureMatrix

    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = docs.join(table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "match").otherwise("mismatch").alias("label")), "doc_id")
    kept = FeatureMatrix(spark, storage.new_path(spark, "matrix"), ["text"], META, lambda df: text.with_text_meta(df).select("content_key", *META))
    kept.update(rows.where("doc_id % 2 = 0"))
    kept.update(rows)
    if kept.update(rows):
        raise RuntimeError("rows that are known were computed again")
    out = kept.matrix(rows, keep=("doc_id",))
    return out.select("doc_id", "label", "y", *[F.round(c, 9).alias(c) for c in META])


@query(f"""WITH m AS ({SQL["text_meta"]}) SELECT count(*) AS n_rows, count(*) FILTER (WHERE unique_word_ratio >= 0.5) AS n_ok, round(count(*) FILTER (WHERE unique_word_ratio >= 0.5) / count(*), 9) AS ok_rate, 100.0::DOUBLE AS percent,
  count(*) FILTER (WHERE quality = 1) AS n_match, count(*) FILTER (WHERE quality = 0) AS n_mismatch FROM labels JOIN m USING (doc_id)""")
def measured_run(spark: SparkSession, d: str) -> DataFrame:
    """What a run observed of the rows that it wrote, in the pass that wrote them."""
    from pairlens.streaming.measured import write_measured

    rows = text.with_text_meta(table(spark, d, "documents").select("doc_id", "text")).join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", *META)
    total = table(spark, d, "labels").count()
    seen = write_measured(rows, storage.new_path(spark, "measured"), F.col("unique_word_ratio") >= 0.5, total, n_match=F.count_if(F.col("quality") == 1), n_mismatch=F.count_if(F.col("quality") == 0))
    names = ["n_rows", "n_ok", "ok_rate", "percent", "n_match", "n_mismatch"]
    return spark.createDataFrame([tuple(round(seen[c], 9) if isinstance(seen[c], float) else seen[c] for c in names)], "n_rows long, n_ok long, ok_rate double, percent double, n_match long, n_mismatch long")


# the audit
def _fields() -> dict:
    return {"lang": F.col("lang"), "source": F.col("source"), "domain": F.concat_ws("/", "source", "lang"), "initial": F.substring("norm", 1, 1), "digest": F.md5("norm")}


_FIELD_SQL = {"lang": "lang", "source": "source", "domain": "source || '/' || lang", "initial": "substr(norm, 1, 1)", "digest": "md5(norm)"}
_NUMBERS = f"""count(*) AS n_values, sum(n) AS n_rows, sum(m) AS match, sum(x) AS mismatch, min(n) AS min_size, max(n) AS max_size, avg(n) AS mean_size, count(*) FILTER (WHERE n >= 2) AS duplicate_groups,
  coalesce(sum(n) FILTER (WHERE n >= 2), 0) AS duplicate_rows, count(*) FILTER (WHERE m > 0 AND x > 0) AS opposite_groups, coalesce(sum(n) FILTER (WHERE m > 0 AND x > 0), 0) AS opposite_rows, count(*) FILTER (WHERE m > 0) AS support_match,
  count(*) FILTER (WHERE x > 0) AS support_mismatch, sum(greatest(m, x)) AS best, sum(n * {_bits("m", "x")}) AS h"""
_DERIVED = f"""CAST(mismatch AS DOUBLE) / n_rows AS mismatch_rate, least(support_match, support_mismatch) AS max_folds, CAST(best AS DOUBLE) / n_rows AS majority_accuracy, {_bits("match", "mismatch")} AS label_entropy,
  h / n_rows AS conditional_entropy, {_bits("match", "mismatch")} - h / n_rows AS mutual_information, CASE WHEN {_bits("match", "mismatch")} > 0 THEN ({_bits("match", "mismatch")} - h / n_rows) / {_bits("match", "mismatch")} ELSE 0.0 END AS normalized_mutual_information"""


def _sql_fields(by: dict[str, str]) -> str:
    one = " UNION ALL ".join(f"SELECT '{name}' AS field, CAST({e} AS VARCHAR) AS v, y FROM t" for name, e in by.items())
    return f"""k AS ({one} UNION ALL SELECT NULL, NULL, y FROM t), v AS (SELECT field, v, count(*) AS n, count(*) FILTER (WHERE y = 1) AS m, count(*) FILTER (WHERE y = 0) AS x FROM k GROUP BY field, v),
a AS (SELECT field, {_NUMBERS} FROM v GROUP BY field), f AS (SELECT field, n_values, n_rows, match, mismatch, min_size, max_size, mean_size, duplicate_groups, duplicate_rows, opposite_groups, opposite_rows, support_match, support_mismatch, {_DERIVED} FROM a)"""


_ROUNDED = ["mean_size", "mismatch_rate", "majority_accuracy", "label_entropy", "conditional_entropy", "mutual_information", "normalized_mutual_information"]
_WHOLE = ["n_values", "n_rows", "match", "mismatch", "min_size", "max_size", "duplicate_groups", "duplicate_rows", "opposite_groups", "opposite_rows", "support_match", "support_mismatch", "max_folds"]


@query(f"WITH {TEXTS}, {_sql_fields(_FIELD_SQL)} SELECT field, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _WHOLE)}, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in _ROUNDED)} FROM f")
def audit_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every audited field in one scan."""
    out = audit.audited_fields(labelled_texts(spark, d), _fields())
    return out.select("field", *[F.col(c).cast("long").alias(c) for c in _WHOLE], *[(F.round(c, 9) + 0.0).alias(c) for c in _ROUNDED])


_REPORT_NUMBERS = [c for c in [*_WHOLE, *_ROUNDED] if c not in ("n_rows", "match", "mismatch")]


@query(rf"""WITH {TEXTS}, {_sql_fields({"lang": "lang", "source": "source"} | {"text norm": "CASE WHEN norm <> '' THEN sha256(norm) END"})},
u AS (SELECT field, unnest([{", ".join(f"'{c}'" for c in _REPORT_NUMBERS)}]) AS k, unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in _REPORT_NUMBERS)}]) AS v FROM f WHERE field IS NOT NULL),
d AS (SELECT norm, min(sample_id) AS id, count(*) AS copies FROM t WHERE norm <> '' GROUP BY norm), w AS (SELECT id, copies, list_distinct(regexp_extract_all(norm, '[\pL\pN\pM_]+')) AS s FROM d), z AS (SELECT id, unnest(s) AS tok FROM w),
i AS (SELECT a.id AS l, b.id AS r, count(*) AS c FROM z a JOIN z b ON a.tok = b.tok AND a.id < b.id GROUP BY ALL),
p AS (SELECT l, r, CAST(c AS DOUBLE) / (len(x.s) + len(y.s) - c) AS jac, x.copies + y.copies AS n FROM i JOIN w x ON x.id = l JOIN w y ON y.id = r UNION ALL SELECT x.id, y.id, 1.0, x.copies + y.copies FROM w x JOIN w y ON x.id < y.id WHERE len(x.s) = 0 AND len(y.s) = 0)
SELECT 'balance' AS section, 'match' AS name, NULL AS ids, CAST(match AS BIGINT) AS n, NULL::DOUBLE AS value FROM f WHERE field IS NULL
UNION ALL SELECT 'balance', 'mismatch', NULL, CAST(mismatch AS BIGINT), NULL FROM f WHERE field IS NULL
UNION ALL SELECT 'field', field || '.' || k, NULL, 0, round(v, 9) + 0.0 FROM u
UNION ALL SELECT 'contradiction', lang || '|' || md5(norm), array_to_string(list_sort(list(sample_id)), ','), count(*), NULL FROM t GROUP BY lang, norm HAVING count(DISTINCT y) > 1
UNION ALL SELECT 'exact:norm', sha256(norm), array_to_string(list_sort(list(sample_id)), ','), count(*), CAST(count(DISTINCT y) > 1 AS DOUBLE) FROM t WHERE norm <> '' GROUP BY norm HAVING count(*) >= 2
UNION ALL SELECT 'near:norm', '', l || ',' || r, n, round(jac, 9) FROM p WHERE jac >= 0.8""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole audit: balance, every field's numbers, contradictions, equal and alike texts with their pairs."""
    out = audit.report(labelled_texts(spark, d), ["norm"], {"lang": F.col("lang"), "source": F.col("source")}, [F.col("lang"), F.md5("norm")], least=0.8)
    return out.withColumn("value", F.round("value", 9) + 0.0)


@query("""WITH e AS (SELECT lang, CASE WHEN n_chars >= 500 THEN 'long' ELSE 'short' END AS kind, source, coalesce(text, '') AS text FROM documents),
a AS (SELECT lang, count(*) AS n, avg(length(text)) AS mean_chars, avg(CASE WHEN text LIKE '%@%' THEN 1.0 ELSE 0.0 END) AS mail FROM e GROUP BY lang), k AS (SELECT lang, kind, count(*) AS n, CAST(count(DISTINCT source) AS DOUBLE) AS sources FROM e GROUP BY lang, kind)
SELECT lang, 'n' AS name, CAST(n AS DOUBLE) AS value FROM a UNION ALL SELECT lang, 'text_chars_mean', round(mean_chars, 9) FROM a UNION ALL SELECT lang, 'text_mail', round(mail, 9) FROM a
UNION ALL SELECT lang, 'kind_' || kind || '_n', CAST(n AS DOUBLE) FROM k UNION ALL SELECT lang, 'kind_' || kind || '_sources', sources FROM k""")
def flat_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Nested metrics of each language, structs within structs and a map of structs by kind, as rows of name and value."""
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents").select("lang", "source", t.alias("text"), F.when(F.col("n_chars") >= 500, "long").otherwise("short").alias("kind"))
    kinds = docs.groupBy("lang", "kind").agg(F.struct(F.count("*").alias("n"), F.count_distinct("source").alias("sources")).alias("m")).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("kind", "m"))).alias("kind"))  # two kinds
    own = docs.groupBy("lang").agg(F.count("*").alias("n"), F.struct(F.struct(F.avg(F.length("text")).alias("mean")).alias("chars"), F.avg(F.col("text").contains("@").cast("double")).alias("mail")).alias("text"))
    return nested.unpivot(own.join(kinds, "lang"), keep=("lang",)).withColumn("value", F.round("value", 9))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings), b AS (SELECT vec_id, least(CAST(floor((CAST(x AS DOUBLE) + 1) * 128) AS INT), 255) AS bin FROM e WHERE x >= -1 AND x < 1),
c AS (SELECT vec_id, bin, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT vec_id, sum(n) AS total FROM c GROUP BY vec_id)
SELECT vec_id, count(*) AS filled, round(-sum(n / total * log2(n / total)), 9) + 0.0 AS entropy FROM c JOIN s USING (vec_id) GROUP BY vec_id""")
def value_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the values of each vector in 256 equal bins, as that of grey levels."""
    rows = features.with_histogram(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", "h", -1.0, 1.0)
    return rows.select("vec_id", F.size("h").cast("long").alias("filled"), (F.round(features.entropy_bits(F.map_values("h")), 9) + 0.0).alias("entropy"))


# metrics and pure columns
@query(f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= 0.6) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.6) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.6) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.6) AS tn FROM s),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s), a AS (SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q, sum(r) FILTER (WHERE y = 1) AS rs FROM r)
SELECT tp, fp, fn, tn, {sql_metrics()}, round((rs - p * (p + 1) / 2.0) / (p * q), 9) AS roc_auc FROM c, a""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    """Confusion, class-wise metrics and AUC in one row."""
    out = metrics.class_report(scored(spark, d), 0.6)
    return out.select("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "f1_mismatch", "macro_f1", "min_class_f1", F.round("roc_auc", 9).alias("roc_auc"))


@query(sql_best(ABOVE, BALANCE))
def score_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The balanced threshold among the scores themselves, and above them."""
    return thresholds.best_balanced_scores(scored(spark, d))


@query(f"""WITH s AS (SELECT doc_id, {NORM} AS norm FROM documents) SELECT doc_id, sha256(norm) AS sha, CAST(len(list_distinct(regexp_extract_all(norm, '[\\pL\\pN\\pM_]+'))) AS BIGINT) AS n_tokens,
  array_to_string(list_sort(list_distinct(regexp_extract_all(norm, '[\\pL\\pN\\pM_]+'))), ' ') AS tokens FROM s""")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", text.lower_space(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", F.sha2("norm", 256).alias("sha"), F.array_sort(text.token_set(F.col("norm"))).alias("t"))
    return rows.select("doc_id", "sha", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"""WITH {SCORED}, l AS (SELECT doc_id, y, ln(greatest(score, 0.01) / (1.01 - greatest(score, 0.01))) AS z FROM s), p AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM l)
SELECT doc_id, round(power(1 - CASE WHEN y = 1 THEN p ELSE 1 - p END, 2.0) * CASE WHEN y = 1 THEN 3.0 ELSE 1.0 END * -ln(CASE WHEN y = 1 THEN p ELSE 1 - p END), 9) AS loss FROM p""")
def focal_losses(spark: SparkSession, d: str) -> DataFrame:
    s = F.greatest(F.col("score"), F.lit(0.01))
    return scored(spark, d).select("doc_id", F.round(features.focal_loss(F.log(s / (1.01 - s)), F.col("y"), 2.0, 3.0), 9).alias("loss"))


@query("""SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 100""")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of a hundred documents without replacement."""
    return splits.sample(table(spark, d, "documents").select("doc_id"), 100, "doc_id")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, k <= round_even(n * 0.7, 0) AS is_train FROM r""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.train_test(table(spark, d, "documents").select("doc_id", "source"), "doc_id", by=["source"])


@query("""WITH p AS (SELECT source, lang, CAST(round_even(count(*) * 0.5, 0) AS INT) AS quota FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL),
r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('42:' || doc_id), doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, source, lang FROM r LEFT JOIN p USING (source, lang) WHERE k <= coalesce(quota, 0)""")
def unpaired_quota(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "lang"), table(spark, d, "labels").select("doc_id")
    return splits.unpaired_quota(docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti"), ["source", "lang"], "doc_id")


@query(rf"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS a, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS b FROM benchmark),
c AS (SELECT doc_id, len(list_intersect(a, b)) AS tp, len(a) - len(list_intersect(a, b)) AS fp, len(b) - len(list_intersect(a, b)) AS fn FROM d JOIN b USING (item_id))
SELECT doc_id, CAST(tp AS INT) AS tp, CAST(fp AS INT) AS fp, CAST(fn AS INT) AS fn, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM c""")
def set_f1(spark: SparkSession, d: str) -> DataFrame:
    """F1 of each document's words against those of a benchmark item."""
    items = table(spark, d, "benchmark")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    docs = table(spark, d, "documents").select("doc_id", words("text").alias("a"), (F.col("doc_id") % items.count()).alias("item_id"))
    out = docs.join(items.select("item_id", words("text").alias("b")), "item_id").withColumns(metrics.set_counts(F.col("a"), F.col("b")))
    f1 = metrics.f1_columns(F.col("tp"), F.col("fp"), F.col("fn"), empty=1.0)["f1"]
    return out.select("doc_id", "tp", "fp", "fn", F.round(f1, 9).alias("f1"))


@query("""WITH a AS (SELECT doc_id % 500 AS k, arg_max(lang, doc_id) AS lang, arg_max(source, doc_id) AS source FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), b AS (SELECT doc_id % 500 AS k, arg_max(lang, doc_id) AS lang, arg_max(source, doc_id) AS source FROM documents WHERE doc_id % 3 = 1 GROUP BY 1)
SELECT page_id, CASE WHEN a.k IS NOT NULL THEN a.lang ELSE b.lang END AS lang, CASE WHEN a.k IS NOT NULL THEN a.source ELSE b.source END AS source FROM pages LEFT JOIN a ON a.k = page_id % 500 LEFT JOIN b ON b.k = page_id % 500""")
def sidecar_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of each page from the first of two tables of sidecars that has its key."""
    docs = table(spark, d, "documents").withColumn("k", F.col("doc_id") % 500)
    side = lambda m: docs.where(F.col("doc_id") % 3 == m).groupBy("k").agg(F.max_by("lang", "doc_id").alias("lang"), F.max_by("source", "doc_id").alias("source"))
    pages = table(spark, d, "pages").select("page_id", (F.col("page_id") % 500).alias("k"))
    return matching.with_sidecars(pages, [side(0), side(1)], "k", ["lang", "source"]).drop("k")
