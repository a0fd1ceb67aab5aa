"""Hard-negative mining by a pivot table.

Vectors are whole numbers here, and a score is their exact inner product.
Every row x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm,
so that all rows lie on a sphere of radius M; an anchor q is scaled to that
radius and gets a zero.  Then the distance of the two tells their score:
2 * scale * score = 2 * M^2 - distance^2.  The pivot table stores each row's
distances to a few pivots, rows chosen far from each other in a sample by hash
of SAMPLED rows (which only decides how tight brackets are).  By the triangle
inequality these distances bracket every score, for a block of rows at once and
then for each of its rows; only rows whose bracket reaches what is wanted are
multiplied out, and those products alone decide.

Anchors meet rows in cells of a grid, a group of anchors and a slice of rows
each, both dealt by hash: copies of a vector and rows of a frequent label are
spread over all slices, and no task holds more than a cell.  A cell returns its
best few rows for an anchor; a window over those of all slices ends the search.
The work is that of all anchors against all rows, as the query set demands, less
what brackets save.

Nulls and edge cases: rows without id, label or vector, or with a component
that is null or not finite, take no part; a shorter vector counts as followed by
zeros; rows alike in id, label and vector count once; rows of one id with
different vectors are rows of their own, and never each other's positives; an
empty table gives no rows; other columns are not looked at.  Scores that may not
fit 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.llm.common import Tables, tidy

PIVOTS, SAMPLED = 8, 1024
#: Anchors and rows of a cell at most, rows of a cell at least; anchors and rows that are bracketed together.
GROUP, SLICE, LEAST_SLICE = 16_384, 65_536, 4096
BATCH, BLOCK = 256, 512
#: Share of M^2 / scale by which brackets are widened: stored distances are in single precision.
SLACK = 1e-5
NONE = np.iinfo(np.int64).min


def points(table: DataFrame, vec_id: Column, label: Column, vector: Column, scale: float) -> DataFrame:
    """id, label and v, whole numbers floor(scale * x), of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(vec_id.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("x"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite)).select("id", "label", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))


def matrix(v: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """A list column as rows of size numbers, shorter ones followed by zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    flat, n = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
    if (n == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(n), size), np.int64)
    out[np.arange(size) < n[:, None]] = flat
    return out


def choose_pivots(sample: np.ndarray, radius2: float, most: int = PIVOTS) -> np.ndarray:
    """Up to most rows of the sample, each the farthest from those before it."""
    lifted = np.column_stack([sample, np.sqrt(np.maximum(radius2 - (sample.astype(float) ** 2).sum(1), 0))])
    near, chosen = np.full(len(sample), np.inf), [0]
    while len(chosen) < most:
        near = np.minimum(near, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return sample[chosen]


class Space:
    """Distances and brackets for vectors of one table.

    radius2: the largest squared norm.  wide: whether products pass 2**53, where doubles are no longer exact.
    """

    def __init__(self, pivots: np.ndarray, radius2: float, wide: bool):
        self.pivots, self.radius2, self.wide = pivots.astype(float), float(radius2), wide
        self.height = np.sqrt(np.maximum(radius2 - (self.pivots**2).sum(1), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        height = np.sqrt(np.maximum(self.radius2 - (x**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.radius2 - 2 * (x @ self.pivots.T + height[:, None] * self.height), 0)).astype(np.float32)

    def of_anchors(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distances, scales, the sums of squares that a score is taken from, and slacks."""
        q = q.astype(float)
        norm = np.sqrt((q**2).sum(1))
        scale = np.where(norm > 0, np.sqrt(self.radius2) / np.where(norm > 0, norm, 1), 1.0)
        squares = np.where(norm > 0, self.radius2, 0.0) + self.radius2
        d = np.sqrt(np.maximum(squares[:, None] - 2 * scale[:, None] * (q @ self.pivots.T), 0)).astype(np.float32)
        return d, scale, squares, SLACK * self.radius2 / scale + 1e-6

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return q.astype(np.int64) @ x.astype(np.int64).T if self.wide else (q.astype(float) @ x.astype(float).T).astype(np.int64)


class Rows:
    """Rows of a cell in blocks that pivots and labels keep close together, with the bounds of each block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, dist: np.ndarray):
        seen: set = set()
        once = [k for k, key in enumerate(zip(ids.tolist(), labels.tolist(), map(bytes, np.ascontiguousarray(v)))) if not (key in seen or seen.add(key))]
        home = dist.argmin(1)
        order = np.lexsort((dist.min(1), home, labels))
        order = order[np.isin(order, once)] if len(once) < len(ids) else order
        self.ids, self.labels, self.v, self.dist = ids[order], labels[order], v[order], dist[order]
        self.blocks = [slice(a, min(a + BLOCK, len(order))) for a in range(0, len(order), BLOCK)]
        bounds = lambda f, x: np.array([f(x[b], axis=0) for b in self.blocks])
        self.low, self.high = bounds(np.min, self.dist), bounds(np.max, self.dist)
        self.first, self.last = bounds(np.min, self.labels), bounds(np.max, self.labels)


class Best:
    """For each anchor the k best (score, id) so far: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def last(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of at; NONE where an id doesn't count."""
        floor = self.last()[at]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        a, x = np.nonzero((scores >= floor[:, None]) & (scores > NONE))
        if not len(a):
            return
        mine = np.unique(a)
        who = np.concatenate([np.repeat(mine, self.k), a])
        score = np.concatenate([self.scores[at[mine]].ravel(), scores[a, x]])
        name = np.concatenate([self.ids[at[mine]].ravel(), ids[x]])
        order = np.lexsort((name, -score, who))  # -NONE is NONE, hence the next line
        order = order[np.lexsort((score[order] == NONE, who[order]))]
        rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.scores[at[who[order]], rank], self.ids[at[who[order]], rank] = score[order], name[order]


def search(space: Space, rows: Rows, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, k: int, bands: tuple[np.ndarray, np.ndarray] | None = None) -> list[Best]:
    """Without bands, one Best with the k best other rows of each anchor's label; with bands, arrays (anchor, j) of the
    least and the highest score wanted, a Best for each j with the k best rows of other labels within the band."""
    out = [Best(len(ids), k) for _ in range(1 if bands is None else bands[0].shape[1])]
    for a in range(0, len(ids), BATCH):
        b = slice(a, min(a + BATCH, len(ids)))
        d, scale, squares, slack = space.of_anchors(q[b])
        least = np.full((len(d), 1), NONE) if bands is None else bands[0][b]
        most = np.full((len(d), 1), np.iinfo(np.int64).max) if bands is None else bands[1][b]
        near = np.maximum(d[:, None] - rows.high, rows.low - d[:, None]).max(2).clip(min=0).astype(float)
        far = (d[:, None] + rows.high).min(2).astype(float)
        above = (squares[:, None] - near**2) / (2 * scale[:, None]) + slack[:, None]
        below = (squares[:, None] - far**2) / (2 * scale[:, None]) - slack[:, None]
        for n in np.argsort(-above.max(0), kind="stable"):
            block = rows.blocks[n]
            floor = np.stack([np.maximum(least[:, j], best.last()[b]) for j, best in enumerate(out)], 1)
            can = ((above[:, [n]] >= floor) & (below[:, [n]] <= most) & (floor <= most)).any(1)
            lab = labels[b]
            can &= (lab >= rows.first[n]) & (lab <= rows.last[n]) if bands is None else ~((lab == rows.first[n]) & (lab == rows.last[n]))
            at = np.flatnonzero(can)
            if not len(at):
                continue
            x = rows.dist[block]
            near_ = np.abs(d[at, None, 0] - x[None, :, 0])
            far_ = d[at, None, 0] + x[None, :, 0]
            for p in range(1, x.shape[1]):
                np.maximum(near_, np.abs(d[at, None, p] - x[None, :, p]), out=near_)
                np.minimum(far_, d[at, None, p] + x[None, :, p], out=far_)
            up = (squares[at, None] - near_.astype(float) ** 2) / (2 * scale[at, None]) + slack[at, None]
            down = (squares[at, None] - far_.astype(float) ** 2) / (2 * scale[at, None]) - slack[at, None]
            active = floor[at] <= most[at]
            lowest, highest = np.where(active, floor[at], np.iinfo(np.int64).max).min(1), np.where(active, most[at], NONE).max(1)
            want = (up >= lowest[:, None]) & (down <= highest[:, None])
            same = lab[at, None] == rows.labels[block]
            want &= same & (ids[b][at, None] != rows.ids[block]) if bands is None else ~same
            some, cols = want.any(1), want.any(0)
            if not some.any():
                continue
            at, want = at[some], want[some][:, cols]
            score = np.where(want, space.products(q[b][at], rows.v[block][cols]), NONE)
            for j, best in enumerate(out):
                inside = score if bands is None else np.where((score >= least[at, j, None]) & (score <= most[at, j, None]), score, NONE)
                best.add(b.start + at, inside, rows.ids[block][cols])
    return out


def _rows(cell: pa.Table, space: Space, size: int) -> Rows:
    return Rows(cell["id"].to_numpy(), cell["label"].to_numpy(), matrix(cell["v"], size), matrix(cell["dist"], len(space.pivots)))


class Miner:
    """The written pivot table of points, and its anchors."""

    def __init__(self, points: DataFrame, is_anchor: Column):
        self.t, spark = Tables(points.sparkSession), points.sparkSession
        norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        has = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size"), F.max(norm2).alias("radius2"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
        self.n, self.size = has.n, has.size or 0
        if not self.n:
            return
        if has.radius2 >= 2.0**62:
            raise ValueError("scores may not fit 64 bits")
        sample = points.orderBy(F.xxhash64("id", "label", "v"), "id", "label").limit(SAMPLED).select("v").toArrow()
        self.space = space = Space(choose_pivots(matrix(sample["v"], self.size), has.radius2), has.radius2, has.radius2 >= 2.0**52)
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = space.of_rows(matrix(b.column("v"), size))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1], pa.array(d.ravel()))], names=["id", "label", "v", "dist"])

        self.table = self.t.write(points.mapInArrow(tidy(run), "id long, label long, v array<long>, dist array<float>"), "pivot_table")
        alone = self.table.where(is_anchor).select("id", "label", "v").distinct()
        self.anchors = self.t.write(alone.withColumn("akey", F.monotonically_increasing_id()), "anchors")
        self.groups = max(1, -(-has.anchors // GROUP))
        each = min(SLICE, max(LEAST_SLICE, self.n // (2 * spark.sparkContext.defaultParallelism)))
        self.slices = -(-self.n // each)

    def meet(self, anchors: DataFrame, run, schema: str) -> DataFrame:
        """run(rows, anchors), two Arrow tables, for each cell of the grid."""
        rows = self.table.withColumn("s", F.pmod(F.xxhash64("id", "label", "v"), F.lit(self.slices))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        asking = anchors.withColumn("g", F.pmod(F.xxhash64("akey"), F.lit(self.groups)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.slices - 1).cast("long"))))
        return rows.groupBy("g", "s").cogroup(asking.groupBy("g", "s")).applyInArrow(run, schema)

    def positives(self, k: int) -> DataFrame:
        """akey, anchor_id, positive_rank, positive_id, positive_score: the k best other rows of an anchor's label."""
        space, size = self.space, self.size

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["akey", "anchor_id", "positive_id", "positive_score"]
            if not len(left) or not len(right):
                return pa.table({c: pa.array([], pa.int64()) for c in names})
            right = right.sort_by([("label", "ascending"), ("akey", "ascending")])
            key, ids = right["akey"].to_numpy(), right["id"].to_numpy()
            best = search(space, _rows(left, space, size), ids, right["label"].to_numpy(), matrix(right["v"], size), k)[0]
            a, j = np.nonzero(best.scores > NONE)
            return pa.table([key[a], ids[a], best.ids[a, j], best.scores[a, j]], names=names)

        found = self.meet(self.anchors, run, "akey long, anchor_id long, positive_id long, positive_score long")
        w = Window.partitionBy("akey").orderBy(F.desc("positive_score"), "positive_id")
        return found.withColumn("positive_rank", F.row_number().over(w)).where(F.col("positive_rank") <= k)

    def negatives(self, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
        """For each row of positives the k best rows of other labels with low * positive <= 100 * score <= high * positive."""
        space, size = self.space, self.size
        lists = positives.groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("p"))
        asking = self.anchors.join(lists, "akey").select("akey", "id", "label", "v", F.col("p.positive_id").alias("pid"), F.col("p.positive_score").alias("pscore"))
        names = ["akey", "anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table({c: pa.array([], pa.int64()) for c in names})
            right = right.sort_by([("label", "ascending"), ("akey", "ascending")])
            key, ids = right["akey"].to_numpy(), right["id"].to_numpy()
            n = np.asarray([len(x) for x in right["pid"].to_pylist()])
            there = np.arange(n.max()) < n[:, None]
            pid, score = matrix(right["pid"], n.max()), matrix(right["pscore"], n.max())
            whole = score.astype(object) if low * int(np.abs(score).max()) >= 2**62 or high * int(np.abs(score).max()) >= 2**62 else score
            least = np.where(there, (-(-low * whole // 100)).astype(np.int64), np.iinfo(np.int64).max)
            most = np.where(there, (high * whole // 100).astype(np.int64), NONE + 1)
            parts = []
            for j, best in enumerate(search(space, _rows(left, space, size), ids, right["label"].to_numpy(), matrix(right["v"], size), k, (least, most))):
                a, r = np.nonzero(best.scores > NONE)
                parts.append([key[a], ids[a], np.full(len(a), j + 1, np.int64), pid[a, j], score[a, j], best.ids[a, r], best.scores[a, r]])
            return pa.table([np.concatenate(c) for c in zip(*parts)], names=names)

        found = self.meet(asking, run, ", ".join(f"{c} long" for c in names))
        w = Window.partitionBy("akey", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of each anchor and each of its positives, for the table that points() returns."""
    miner = Miner(table, is_anchor)
    if not miner.n:
        return table.sparkSession.createDataFrame([], RESULT)
    near = miner.t.write(miner.positives(positives), "positives")
    return miner.negatives(near, negatives, low, high).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(points(table, F.col("vec_id"), label, F.col("embedding"), 256), F.col("id") % 50 == 0)


OP11_SQL = """
WITH p AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), a AS (SELECT row_number() OVER () AS k, * FROM p WHERE vec_id % 50 = 0
), s AS (
  SELECT a.k, a.vec_id AS anchor_id, p.vec_id AS id, a.label = p.label AS same, CAST(list_inner_product(a.v, p.v) AS BIGINT) AS score
  FROM a, p
), pos AS (
  SELECT * FROM s WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, id) <= 5
), neg AS (
  SELECT pos.anchor_id, pos.id AS positive_id, pos.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY pos.k, pos.id ORDER BY s.score DESC, s.id) AS rank
  FROM pos JOIN s ON s.k = pos.k AND NOT s.same AND 50 * pos.score <= 100 * s.score AND 100 * s.score <= 95 * pos.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
