import pytest
from pyspark.sql import functions as F

from pairlens.operators import audit, matching
from pairlens.sources import readers
from pairlens.streaming import resume


def test_confounding(spark):
    df = spark.createDataFrame([("a", 1)] * 4 + [("b", 0)] * 4, "k string, y int")
    r = audit.confounding(df, "k").first()
    assert r.label_entropy == 1 and r.mutual_information == pytest.approx(1) and r.majority_accuracy == 1


def test_duplicates(spark):
    df = spark.createDataFrame([("1", "t", 1), ("2", "t", 0), ("3", "", 1), ("4", "", 1), ("5", "u", 1)], "sample_id string, t string, y int")
    assert {r.value: r.sample_ids for r in audit.duplicate_groups(df, "t").collect()} == {"t": ["1", "2"], "": ["3", "4"]}
    assert [r.opposite for r in audit.exact_text_groups(df, "t").collect()] == [True]
    assert audit.contradictions(df, [F.col("t")]).count() == 1


def test_near(spark):
    texts = ["a b c d e", "a b c d e f", "e d c b a", "x y", "!", "?", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string")
    got = {(r.left_id, r.right_id): round(r.jaccard, 3) for r in audit.near_jaccard(df).collect()}
    assert got == {(0, 1): 0.833, (1, 2): 0.833, (0, 2): 1.0, (4, 5): 1.0}
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(0, long), (1, long + " end"), (2, " ".join(reversed(long.split())))], "sample_id long, text string")
    assert [(r.left_id, r.right_id) for r in audit.near_ratio(df).collect()] == [(0, 1)]


def test_folds(spark):
    df = spark.createDataFrame([(f"g{i % 9}", i % 2) for i in range(90)], "g string, y int")
    folds = audit.fold_assignment(df, "g", 3)
    assert audit.fold_check(folds).where("valid").count() == 3
    assert folds.collect() == audit.fold_assignment(df, "g", 3).collect()


def test_joins(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "record_key string, ordinal long, v string")
    want = spark.createDataFrame([("a",), ("b",)], "record_key string")
    assert {r.record_key: r.record.v for r in matching.in_expected_order(want, log, "record_key", "ordinal").collect()} == {"a": "y", "b": "z"}
    with pytest.raises(Exception, match="no record for"):
        matching.in_expected_order(spark.createDataFrame([("q",)], "record_key string"), log, "record_key", "ordinal").collect()
    with pytest.raises(ValueError):
        matching.guard_leaks(want, log, {"key": "record_key"})
    refs = spark.createDataFrame([("r1", "d", "3", "b"), ("r2", "d", "4", None)], "ref string, folder string, number string, panel string")
    files = spark.createDataFrame([("d/figure_3.png",), ("d/figure_4a.png",), ("d/figure_4b.png",), ("d/figure_44.png",)], "path string")
    assert {r.ref: r.resolved for r in matching.resolve_panel(refs, files, "ref").collect()} == {"r1": "d/figure_3.png", "r2": "d/figure_4a.png"}
    rows = spark.createDataFrame([("k", 2, "b", "l2"), ("k", 1, "a", "l1"), ("k", 3, "a", "l1")], "k string, o int, object string, lie string")
    r = matching.merge_reasons(rows, ["k"], "o").first()
    assert r.objects == ["a", "b"] and r.lie == "l1; l2"


def test_logs(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"k": "a"}\n\n{"k": "b"}\n[1]\n{"k": "c", ')
    assert sorted(r.k for r in readers.read_log(spark, str(good), "k string").collect()) == ["a", "b"]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"k": "a", \n{"k": "b"}\n')
    with pytest.raises(Exception, match="no JSON"):
        readers.read_log(spark, str(bad), "k string").collect()


def test_figures(spark, tmp_path):
    root = tmp_path / "figures"
    for name, data in {"ml_orig/d1/figure_1.png": b"i", "ml_orig/d1/figure_1.json": b'{"caption": "cap", "text_block": "tb"}', "ml_l2_fail/d1/figure_1.png": b"j", "ml_l2_fail/d1/figure_1.txt": b" words ", "golden/d1/figure_9.png": b"g", "_old/d1/figure_9.png": b"g"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    rows = {r.sample_id: r for r in readers.figures(spark, str(root)).collect()}
    assert set(rows) == {"ml_orig/d1/figure_1", "ml_l2_fail/d1/figure_1"}
    assert rows["ml_orig/d1/figure_1"].premise == "tb" and rows["ml_l2_fail/d1/figure_1"].label == "mismatch" and rows["ml_l2_fail/d1/figure_1"].caption == "words"
    assert [r.split for r in readers.train_splits(spark, str(root)).collect()] == ["ml_l2_fail", "ml_orig"]
    with pytest.raises(ValueError):
        readers.guard_validation("/data/golden/x.jsonl")


def test_configuration(monkeypatch):
    monkeypatch.setenv("PL_A", "1")
    assert readers.interpolate({"x": ["${PL_A}", "${PL_B:two}/y"]}) == {"x": ["1", "two/y"]}
    with pytest.raises(KeyError):
        readers.interpolate("${PL_MISSING}")


def test_resume(spark, tmp_path):
    todo = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "record_key string, v int")
    log = str(tmp_path / "log")
    assert resume.run_once(todo, lambda df: df, log) == 2
    assert resume.run_once(todo, lambda df: df, log) == 0 and spark.read.parquet(log).count() == 2


def test_alike_sets_share_keys_and_others_do_not():
    import numpy as np

    from pairlens.operators.audit import set_keys

    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64)
    lengths = rng.integers(2, 12, 3000)
    keys = lambda at: {(c, k): n for c, k, n in zip(*(x.tolist() for x in set_keys(words[at], lengths[at], 0.8)), strict=True)}
    for n in [*range(1, 40), 63, 64, 100, 101, 300, 900]:
        for _ in range(20):
            a = rng.permutation(3000)[:n]
            out, new = int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2))
            b = np.concatenate([a[min(out, n - 1) :], np.setdiff1d(np.arange(3000), a)[:new]])
            if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
                x, y = keys(a), keys(b)
                both = [k for k in x if k in y]
                assert any(sum(c == k[0] for c, _ in both) >= x[k] for k in both), n
    # a tenth of the words in common, rare or not, makes no candidates
    for _ in range(50):
        a, b = (np.concatenate([np.arange(20), 20 + rng.permutation(2980)[:180]]) for _ in range(2))
        x, y = keys(a), keys(b)
        both = [k for k in x if k in y]
        assert not any(sum(c == k[0] for c, _ in both) >= x[k] for k in both)


def test_a_group_of_alike_texts_is_a_few_blocks(spark):
    import numpy as np

    from pairlens.operators import audit as a

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(300):
        own = list(words)
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            own[k] = f"x{rng.integers(0, 50)}"
        texts.append(" ".join(own))
    texts = list(dict.fromkeys(texts)) + [" ".join(f"w{k}" for k in rng.integers(0, 900, 60)) for _ in range(100)]
    sets = [set(t.split()) for t in texts]
    want = {(i, j): len(x & y) / len(x | y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(x & y) / len(x | y) >= 0.8}
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string")
    got = {(r.left_id, r.right_id): r.jaccard for r in a.near_jaccard(df).collect()}
    assert got == want and len(want) > 10_000
    hashed = df.select(F.col("sample_id").alias("rep"), F.transform(F.array_distinct(F.split("text", " ")), lambda x: F.xxhash64(x)).alias("h"))
    blocks = a._blocks(hashed, 0.8).select("reps").collect()
    assert sorted(i for b in blocks for i in b.reps) == list(range(len(texts))) and len(blocks) < 150 and max(len(b.reps) for b in blocks) <= a.BLOCK_SETS


def test_block_ratio_is_that_of_difflib():
    import time
    from difflib import SequenceMatcher
    from random import Random

    from pairlens.functions import blocks

    r = Random(7)
    small, blocks.SMALL = blocks.SMALL, 30
    try:
        for trial in range(600):
            letters = ("ab", "abcd", "abcdefgh é😀")[trial % 3]
            a = [r.choice(letters) for _ in range(r.randint(0, 90))] * r.choice([1, 1, 2])
            b = [r.choice(letters) for _ in range(r.randint(0, 90))] if trial % 4 == 0 else list(a)
            for _ in range(r.randint(0, 12)):
                at = r.randint(0, len(b))
                b[at : at + r.randint(0, 4)] = [r.choice(letters) for _ in range(r.randint(0, 4))]
            a, b = "".join(a), "".join(b)
            want = SequenceMatcher(None, a, b, autojunk=False).ratio()
            assert blocks.block_ratio(a, b, 0.0) == want, (a, b)
            assert blocks.block_ratio(a, b, 0.9) == (want if want >= 0.9 else 0.0)
    finally:
        blocks.SMALL = small
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]
    a = [r.choice(words) for _ in range(20_000)]
    b = list(a)
    for _ in range(40):
        b[r.randrange(len(b))] = "new"
    began = time.time()
    assert 0.99 < blocks.block_ratio(" ".join(a), " ".join(b), 0.95) < 1 and blocks.block_ratio(" ".join(a), " ".join(sorted(a)), 0.95) == 0
    assert time.time() - began < 60  # difflib takes far longer


def test_near_takes_high_thresholds(spark):
    words = [f"w{i}" for i in range(1500)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join([*words, "new"])), (2, " ".join(words[:1490])), (3, "a b")], "sample_id long, text string")
    assert [(r.left_id, r.right_id) for r in audit.near_jaccard(df, least=0.998).collect()] == [(0, 1)]
