import json
import time

import pytest
from pyspark.sql import functions as F

from pairlens.functions import text
from pairlens.operators.matrix import FeatureMatrix
from pairlens.sources import jsonlog, storage
from pairlens.streaming import keyed, measured

SCHEMA = "record_key string, ordinal long, v string"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("record_key", "ordinal", "v"), r))) + "\n" for r in rows))


def go(spark, base, **options):
    stream = spark.readStream.schema(SCHEMA).json(str(base / "in"))
    q = keyed.start(keyed.latest(stream, **options), str(base / "log"), str(base / "checkpoint"), lambda df: df.withColumn("worked", F.upper("v")))
    q.awaitTermination()
    return keyed.state_rows(q)


def log(spark, base):
    return {r.record_key: (r.ordinal, r.worked) for r in keyed.read_log(spark, str(base / "log")).collect()}


def test_restart_late_repeats_and_flat_state(spark, tmp_path):
    put(tmp_path / "in", "a.json", [("a", 1, "x"), ("b", 5, "y"), ("a", 3, "z")])
    assert go(spark, tmp_path) == 2
    assert log(spark, tmp_path) == {"a": (3, "Z"), "b": (5, "Y")}
    put(tmp_path / "in", "b.json", [("a", 2, "late"), ("b", 5, "again"), ("b", 9, "new"), ("c", 1, "c")])
    assert go(spark, tmp_path) == 3  # a restart: what was read is not read again
    assert log(spark, tmp_path) == {"a": (3, "Z"), "b": (9, "NEW"), "c": (1, "C")}
    appended = spark.read.parquet(str(tmp_path / "log"))
    assert appended.count() == 4 and appended.where("v in ('late', 'again')").isEmpty()
    put(tmp_path / "in", "c.json", [(k, 0, "old") for k in "abc"] * 20)
    assert go(spark, tmp_path) == 3 and appended.count() == 4


def test_first_record_only(spark, tmp_path):
    put(tmp_path / "in", "a.json", [("a", 2, "x"), ("a", 1, "first")])
    go(spark, tmp_path, first_only=True)
    put(tmp_path / "in", "b.json", [("a", 7, "later"), ("b", 1, "b")])
    go(spark, tmp_path, first_only=True)
    assert log(spark, tmp_path) == {"a": (1, "FIRST"), "b": (1, "B")}


def test_state_expires(spark, tmp_path):
    put(tmp_path / "in", "a.json", [(f"k{i}", 1, "x") for i in range(20)])
    assert go(spark, tmp_path, ttl_ms=1000) == 20
    time.sleep(1.5)
    put(tmp_path / "in", "b.json", [("new", 1, "x")])
    go(spark, tmp_path, ttl_ms=1000)
    time.sleep(1.5)
    put(tmp_path / "in", "c.json", [("newer", 1, "x")])
    assert go(spark, tmp_path, ttl_ms=1000) <= 3


# logs of JSON lines
def values(spark, path, **options):
    return sorted(json.loads(r.value)["k"] for r in jsonlog.read(spark, str(path), **options).collect())


def test_torn_in_several_files_read_repaired_appended(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    line = lambda k: json.dumps({"k": k, "pad": "ä" * (k % 50)}) + "\n"
    (folder / "a.jsonl").write_text("".join(map(line, range(100))) + '{"k": 1000, "pa')
    (folder / "b.jsonl").write_text("\n" + "".join(map(line, range(100, 150))) + "\n" + line(150).rstrip("\n"))  # whole but for its end
    (folder / "c.jsonl").write_text("".join(map(line, range(151, 160))))
    (folder / "d.jsonl").write_text('{"torn')
    (folder / "e.jsonl").write_text("")
    for file, size in jsonlog.log_files(str(folder)):
        with open(file, "rb") as f:
            whole = list(jsonlog._lines(f, 0, size, size))
            for step in (1, 2, 7, 64, 1000):
                assert [x for a in range(0, size, step) for x in jsonlog._lines(f, a, min(a + step, size), size)] == whole
    for step in (700, 1 << 26):
        assert values(spark, folder, range_bytes=step) == list(range(160))
    fixed = {r.file.rsplit("/", 1)[-1]: (r.kept, r.cut) for r in jsonlog.repair(spark, str(folder)).collect()}
    assert {k: v[1] for k, v in fixed.items()} == {"a.jsonl": 15, "b.jsonl": 0, "d.jsonl": 6} and fixed["d.jsonl"][0] == 0
    with (folder / "a.jsonl").open("a") as f:
        f.write(line(160))
    jsonlog.append(spark.range(161, 200).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("pad")).repartition(3), str(folder))
    assert values(spark, folder, range_bytes=900) == list(range(200))
    assert jsonlog.repair(spark, str(folder)).isEmpty()
    starts = jsonlog.read(spark, str(folder), "k long").where("k = 1").first()
    assert starts.start == len(line(0).encode()) and starts.file.endswith("a.jsonl")


def test_bad_lines_and_failed_commits(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"k": 1}\nnonsense\n{"k": 2}\n')
    with pytest.raises(Exception, match="a.jsonl: no JSON object at byte 9"):
        values(spark, folder)
    other = tmp_path / "other"
    jsonlog.append(spark.range(5).withColumnRenamed("id", "k"), str(other))
    with pytest.raises(Exception, match="no JSON object on one line"):
        spark.range(50).repartition(5).select(F.when(F.col("id") == 33, "broken").otherwise(F.concat(F.lit('{"k": '), "id", F.lit("}"))).alias("value")).write.format("jsonlog").mode("append").save(str(other))
    assert values(spark, other) == list(range(5))  # none of the failed one's records
    (other / f"{jsonlog.OWN}stray.jsonl").write_text('{"k": 77}\n')  # written, but never committed
    assert values(spark, other) == list(range(5))
    with pytest.raises(Exception, match="appended to"):
        spark.range(1).select(F.lit("{}").alias("value")).write.format("jsonlog").mode("overwrite").save(str(other))
    assert values(spark, tmp_path / "nothing") == []


# measured runs
def test_measured_without_a_second_scan(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(1000).repartition(4).select(counted("id").alias("x"))
    info = measured.write_measured(rows, str(tmp_path / "out"), F.col("x") % 4 == 0, total=4000, top=F.max("x"))
    assert seen.value == 1000
    assert (info["n_rows"], info["n_ok"], info["ok_rate"], info["percent"], info["top"]) == (1000, 250, 0.25, 25.0, 999) and info["rows_per_sec"] > 0
    empty = measured.write_measured(rows.limit(0), str(tmp_path / "none"), F.col("x") > 0)
    assert (empty["n_rows"], empty["ok_rate"]) == (0, 0.0)


def test_published_versions(spark, tmp_path):
    folder = str(tmp_path / "features")
    with pytest.raises(FileNotFoundError):
        measured.read_feature_table(spark, folder)
    df = spark.createDataFrame([("match", 1.0), ("mismatch", None)], "label string, f double")
    info = measured.write_feature_table(df, folder, ["f"], {"source": "a test"})
    first, meta = measured.read_feature_table(spark, folder)
    assert meta["n_rows"] == 2 and meta["n_ok"] == 1 and meta["n_match"] == 1 and meta["feature_names"] == ["f"] and meta["source"] == "a test" and meta["version"] and info["n_features"] == 1
    measured.write_feature_table(df.limit(1), folder, ["f"])
    assert measured.read_feature_table(spark, folder)[0].count() == 1 and first.count() == 2  # readers of the earlier version go on
    assert storage.current(spark, folder)["n_rows"] == 1 and not list((tmp_path / "features").glob("*.tmp"))


def test_progress(spark, tmp_path):
    assert measured.due(10, 10, 0, 5.0, -1) == (True, 100) and measured.due(1, 100, 0, 5.0, -1) == (True, 0)
    assert measured.due(2, 100, 0, 5.0, 0) == (False, 0) and measured.due(6, 100, 0, 5.0, 0) == (True, 1) and measured.due(20, 1000, 10, 50.0, 0) == (True, 0)
    for i in range(4):
        put(tmp_path / "in", f"{i}.json", [(f"{i}-{j}", j, "x") for j in range(25)])
    told = []
    listener = measured.Progress(told.append, "seen", total=100, every_percent=50.0)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        counted = stream.observe("seen", *[c.alias(k) for k, c in measured.measures(F.col("ordinal") < 5).items()])
        counted.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if listener.n == 100:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [t["n_rows"] for t in told] == [25, 50, 100] and told[-1]["percent"] == 100.0 and told[-1]["n_ok"] == 20


def test_matrix_computes_what_it_lacks(spark, tmp_path):
    names, asked = ["len_words", "num_digits"], spark.sparkContext.accumulator(0)

    @F.udf("string")
    def look(x):
        asked.add(1)
        return x

    def compute(df):
        return text.with_text_meta(df.select("content_key", look("text").alias("text"))).select("content_key", *names)

    rows = spark.createDataFrame([(1, "one 1", "match"), (2, "two two", "mismatch"), (3, "one 1", "match"), (4, None, "match"), (5, "", "match")], "sample_id int, text string, label string")
    m = FeatureMatrix(spark, str(tmp_path / "m"), ["text"], names, compute)
    with pytest.raises(ValueError, match="empty"):
        m.matrix(rows)
    assert m.update(rows.limit(2)) == 2 and m.update(rows) == 2  # null and empty are two contents
    before = asked.value
    assert m.update(rows) == 0 and asked.value == before
    out = {r.sample_id: tuple(r)[1:] for r in m.matrix(rows).collect()}
    assert out == {1: ("match", 1, 2.0, 1.0), 2: ("mismatch", 0, 2.0, 0.0), 3: ("match", 1, 2.0, 1.0), 4: ("match", 1, 0.0, 0.0), 5: ("match", 1, 0.0, 0.0)}
    with pytest.raises(Exception, match="no label: 9"):
        m.matrix(spark.createDataFrame([(9, "one 1", "perhaps")], rows.schema)).collect()
    with pytest.raises(Exception, match="no features: 9"):
        m.matrix(spark.createDataFrame([(9, "unknown", "match")], rows.schema)).collect()
    again = FeatureMatrix(spark, str(tmp_path / "m"), ["text"], names, compute, version="2")
    assert again.update(rows) == 4  # another version of the features
