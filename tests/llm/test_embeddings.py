import numpy as np

from pairlens.llm import embeddings
from pairlens.llm.hnsw import Graph


def test_recall():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 32))
    x = np.concatenate([centers[rng.integers(0, 40, 1500)] + 0.15 * rng.normal(size=(1500, 32)), rng.normal(size=(500, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.build(x, np.arange(len(x)))
    pairs, neighbours = g.audit(0.9, 0.98, x[::7], np.arange(len(x))[::7])
    assert pairs >= 0.98 and neighbours >= 0.95
    row, node = g.within(x.astype(np.float32), 0.9)
    found = set(zip(row.tolist(), g.ids[node].tolist()))
    truth = set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.9001))))
    assert len(found & truth) >= 0.98 * len(truth)
    again = Graph.load(g.dump())
    assert (again.within(x[:50].astype(np.float32), 0.9)[1] == g.within(x[:50].astype(np.float32), 0.9)[1]).all()


def test_links_at_the_threshold_are_found_with_a_narrow_beam():
    """Vectors without neighbours but planted ones, and a crowd of near copies: the beam for pairs stays narrow where that for neighbours cannot."""
    rng = np.random.default_rng(11)
    crowd = rng.normal(size=(1, 64)) + 0.1 * rng.normal(size=(400, 64))
    x = np.concatenate([rng.normal(size=(4000, 64)), crowd])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.build(x, np.arange(len(x)))
    pairs, neighbours = g.audit(0.95, 0.98, x[::20], np.arange(len(x))[::20])
    assert pairs >= 0.98 and neighbours >= 0.95
    assert g.reach <= g.ef // 2 and Graph.load(g.dump()).reach == g.reach
    q = g.planted(0.95, 1500, seed=3)
    near = q.astype(float) @ g.x.astype(float).T
    truth = set(zip(*(a.tolist() for a in np.nonzero(near >= 0.95))))
    found = set(zip(*(a.tolist() for a in g.within(q, 0.95))))
    assert len(found & truth) >= 0.97 * len(truth)
    edges = g.layers[0]
    assert np.bincount(edges[edges >= 0], minlength=len(x)).min() > 0


def test_small_graphs():
    for n in (1, 2, 3, 70):
        x = np.random.default_rng(n).normal(size=(n, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = Graph.build(x, np.arange(n))
        row, node = g.within(x.astype(np.float32), 0.999999)
        assert {(i, i) for i in range(n)} <= set(zip(row.tolist(), g.ids[node].tolist()))


def test_links_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(1000 + i, [v + 0.1 * float(rng.normal()) for v in rows[i % 30][1]]) for i in range(200)]
    rows += [(5000, None), (5001, [0.0] * 8), (5002, [1.0] + [None] * 7), (5003, [float("nan")] * 8), (5004, rows[0][1]), (5004, rows[0][1]), (5005, [1.0, 2.0]), (5006, [1.0, 2.0]), (5007, []), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n int, links int")
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.asarray(v) / np.linalg.norm(v) if good(v) else None for _, v in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(n)]
    label = list(range(n))
    for i in range(n):
        for j in near[i]:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    ids = {x: min((rows[i][0] for i in range(n) if label[i] == x and rows[i][0] is not None), default=None) for x in set(label)}
    want = sorted((str(rows[i][0]), len(near[i]), str(ids[label[i]])) for i in range(n))
    out = embeddings.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
