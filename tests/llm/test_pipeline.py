import corpus_pipeline
import duckdb

from pairlens.llm import registry

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == list(COLUMNS), name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and 0 < sizes[3] <= sizes[2]
    full = docs.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert (full <= 4096).all() and len(full) <= -(-int(full.sum()) // 4096) + 1


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        got = registry.QUERIES[name](spark, d)
        rows = c.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(rows, key=key), name
