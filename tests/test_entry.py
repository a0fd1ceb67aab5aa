import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_ensemble_grid_reads_its_models_from_a_table(spark, tmp_path):
    from pairlens.plans import queries

    spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "x"), (None, None)], "p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = [tuple(r) for r in queries.ensemble_grid(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(t, "x", w, f"ensemble_{t}_x_xgb{w}", i + 1) for i, (w, t) in enumerate((w, t) for w in (0.75, 0.5, 0.25) for t in ("b", "a"))]
