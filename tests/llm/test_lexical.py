import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import lexical

DOCS = "doc_id long, text string, n long, df int, block string"


def terms(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, queries, k=20):
    """The contract by loops: sorted (query's place, rank, doc_id, score)."""
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, queries, parts=3, k=20):
    d = spark.createDataFrame([(*x, 5, 6, "x") for x in docs], DOCS).repartition(parts)
    q = spark.createDataFrame([(*x, 1) for x in queries], "item_id long, text string, term int")
    return sorted((tuple(r) for r in lexical.rank(d, q, F.col("item_id"), F.col("text"), k).collect()), key=str)


def corpus(n=300, words=60, seed=0):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, words + 1)
    return [(int(i), " ".join(f"w{w}" for w in rng.choice(words, int(rng.integers(1, 80)), p=p / p.sum()))) for i in rng.permutation(n)]


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 37)
    monkeypatch.setattr(lexical, "TOGETHER", 3)
    docs = corpus() + [(900 + i, "tied words here, tied again") for i in range(40)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w1 nobody"), (None, None), (800, None), (801, ""), (802, " .,; \n"), (803, "ÉCOLE École école ÀB 漢字 💡 x_y\x7fz " * 3), (804, "w3 " * 30_000)]
    queries = [(0, "w1 w2 w3"), (1, "W1, w1! w1?"), (2, "tied Tied again"), (3, "unheard of"), (4, None), (5, ""), (6, "école École x y z 漢字"), (7, "w3 w3 w3 w3 w3 w40 nobody"), (8, " ".join(f"w{k}" for k in range(60)))]
    assert ranked(spark, docs, queries) == plain(docs, queries)
    assert ranked(spark, docs, queries, k=3) == plain(docs, queries, 3)


def test_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERIES", 2)
    monkeypatch.setattr(lexical, "POSTINGS", 64)
    docs, queries = corpus(80, seed=1), [(i, f"w{i} w{i + 1} w{2 * i}") for i in range(9)]
    assert ranked(spark, docs, queries) == plain(docs, queries)


def test_empty(spark):
    assert ranked(spark, [], [(0, "a")]) == [] and ranked(spark, [(0, "a b"), (1, "c")], []) == []
    assert ranked(spark, [(0, None), (1, "..")], [(0, "a")]) == []


def test_slices_add_up_and_rank():
    rng = np.random.default_rng(3)
    size = 500
    tables = [np.where(rng.random(size) < p, rng.integers(0, 1 << 20, size), 0) for p in (0.01, 0.2, 0.9, 1.0)]
    packed = []
    for v in tables:
        at = np.flatnonzero(v)
        packed.append((lexical.places(at, size), lexical.slices(v[at]), len(at)))
    asked = [[(0, 1), (1, 3)], [(2, 6), (3, 1), (1, 1)], [(0, 1)]]
    total = lexical.added(asked, lambda i: lexical.spread(*packed[i], size), size)
    for (at, score), row in zip(lexical.top(total, 20), asked):
        want = sum(tables[t] * n for t, n in row)
        best = sorted((-s, i) for i, s in enumerate(want) if s)[:20]
        assert sorted(zip((-score).tolist(), at.tolist())) == best


def test_blocks_are_row_groups_of_few(spark):
    """A task's blocks, megabytes each, are not held in memory together, neither by the writer nor by the reader."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from pairlens.llm import common

    t = common.Tables(spark)
    rows = spark.range(0, 40, 1, 1).select("id", F.transform(F.sequence(F.lit(0), F.lit(250_000)), lambda x: F.xxhash64(x, "id")).alias("x"))
    out = t.write(rows, "large", large=True)
    files = [pq.ParquetFile(f) for f in glob.glob(f"{t.paths[id(out)]}/*.parquet")]
    assert max(f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)) <= 12
    assert out.select(F.sum(F.size("x"))).first()[0] == 40 * 250_001
    t.drop(out)
