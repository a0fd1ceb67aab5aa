"""Many logistic regressions at once: every candidate on every training set, in as many scans as Newton steps.

A model is a penalty and a fold of a repeat; it learns from the rows outside of
that fold.  One scan sums the loss, gradient and curvature of every model, rows
staying where they are: a task returns one row of sums for each model, and the
sums of all tasks, some hundred numbers a model, reach the driver, which takes
the steps.  What is minimised is what models.estimator() minimises: features at
zero mean and unit deviation of the training set, classes weighted alike, and
1 / (C n) as the weight of the squared coefficients.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.models import Candidate


def sum_arrays(rows: DataFrame, keys: list[str], values: str) -> dict[tuple, np.ndarray]:
    """The element-wise sum of an array column for each key; keys and lengths are few."""
    out: dict[tuple, list] = {}
    summed = rows.select(*keys, F.posexplode(values).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    for r in summed.collect():
        out.setdefault(tuple(r[k] for k in keys), []).append((r.i, r.x))
    return {k: np.asarray([x for _, x in sorted(v)]) for k, v in out.items()}


def prepare(rows: DataFrame, folds: DataFrame, group: str, key: str, features: list[str], y: str = "y") -> DataFrame:
    """key, y, x (the features) and fold (an array, one for each repeat) of every row of a group that has folds.

    folds: repeat, group and fold, as splits.repeated_folds gives them.
    """
    per_group = folds.groupBy(F.col("group").alias(group)).agg(F.transform(F.sort_array(F.collect_list(F.struct("repeat", "fold"))), lambda s: s["fold"].cast("int")).alias("fold"))
    x = F.array(*[F.col(c).cast("double") for c in features])
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v)) | F.col(y).isNull()
    checked = F.when(bad, F.raise_error(F.lit("a feature or a label is missing"))).otherwise(x)
    return rows.join(per_group, group).select(key, F.col(y).cast("int").alias("y"), checked.alias("x"), "fold")


def _arrays(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return b.column("x").flatten().to_numpy().reshape(-1, d), b.column("y").to_numpy(), b.column("fold").flatten().to_numpy().reshape(len(b), -1)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.array(list(a), pa.list_(pa.float64()))


@dataclass
class Sets:
    """Training sets by (repeat, fold): sizes, mean and deviation of the features, and weights of the two classes."""

    n: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # (repeat, fold, class)


def training_sets(table: DataFrame, repeats: int, k: int, d: int) -> Sets:
    """One scan: moments of each held-out fold about a common centre, hence those of what is left."""
    centre = np.asarray(table.select(*[F.avg(F.get("x", j)) for j in range(d)]).first(), float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((repeats, k, 2 + 2 * d))
        for b in batches:
            x, y, fold = _arrays(b, d)
            x = x - centre
            row = np.column_stack([np.ones(len(x)), y, x, x * x])
            for r in range(repeats):
                np.add.at(total[r], fold[:, r], row)
        yield pa.RecordBatch.from_pydict({"repeat": np.repeat(np.arange(repeats, dtype=np.int32), k), "fold": np.tile(np.arange(k, dtype=np.int32), repeats), "sums": list(total.reshape(-1, 2 + 2 * d))})

    held = sum_arrays(table.mapInArrow(run, "repeat int, fold int, sums array<double>"), ["repeat", "fold"], "sums")
    held = np.asarray([[held[r, f] for f in range(k)] for r in range(repeats)])
    left = held.sum(1, keepdims=True) - held
    n, pos, first, second = left[..., 0], left[..., 1], left[..., 2 : 2 + d], left[..., 2 + d :]
    if ((pos == 0) | (pos == n)).any():
        raise ValueError("a model needs both classes")
    mean = first / n[..., None]
    variance = np.maximum(second - n[..., None] * mean**2, 0) / np.maximum(n - 1, 1)[..., None]
    deviation = np.sqrt(variance)
    scale = np.where(deviation > 1e-12 * (1 + np.abs(mean)), 1 / np.where(deviation > 0, deviation, 1), 0.0)  # a constant says nothing
    return Sets(n, mean + centre, scale, np.stack([n / (2 * (n - pos)), n / (2 * pos)], -1))


class Search:
    """coefficients[r, f, c]: weights of the scaled features and, last, the constant, of candidate c on what fold f of repeat r leaves."""

    def __init__(self, table: DataFrame, candidates: list[Candidate], repeats: int, k: int, features: list[str], tolerance: float = 1e-10, most_scans: int = 100):
        self.table, self.candidates, self.features = table, candidates, features
        self.sets = sets = training_sets(table, repeats, k, d := len(features))
        c = np.asarray([m.params["C"] for m in candidates])
        penalty = 1 / (c[None, None, :] * sets.n[..., None])
        beta, step = np.zeros((repeats, k, len(c), d + 1)), np.zeros((repeats, k, len(c), d + 1))
        before, loss_before = beta.copy(), np.full(penalty.shape, np.inf)
        busy = np.ones(penalty.shape, bool)
        self.scans = 0
        while busy.any():
            if self.scans == most_scans:
                raise RuntimeError(f"{busy.sum()} models have not settled in {most_scans} scans")
            sums = self._scan(beta, busy, d)
            self.scans += 1
            for (r, f, j), s in sums.items():
                own, lam = beta[r, f, j], penalty[r, f, j]
                loss = s[0] / sets.n[r, f] + lam / 2 * (own[:-1] ** 2).sum()
                if loss > loss_before[r, f, j] + 1e-12 * abs(loss):  # a step too far: half of it
                    step[r, f, j] /= 2
                    beta[r, f, j] = before[r, f, j] + step[r, f, j]
                    continue
                gradient, curvature = s[1 : d + 2] / sets.n[r, f], np.zeros((d + 1, d + 1))
                curvature[np.triu_indices(d + 1)] = s[d + 2 :] / sets.n[r, f]
                curvature += np.triu(curvature, 1).T
                gradient[:-1] += lam * own[:-1]
                curvature[np.arange(d), np.arange(d)] += lam
                before[r, f, j], loss_before[r, f, j] = own, loss
                step[r, f, j] = -np.linalg.solve(curvature, gradient)
                beta[r, f, j] = own + step[r, f, j]
                busy[r, f, j] = np.abs(step[r, f, j]).max() > tolerance
        self.coefficients = beta

    def _scan(self, beta: np.ndarray, busy: np.ndarray, d: int) -> dict[tuple, np.ndarray]:
        sets, upper = self.sets, np.triu_indices(d + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((*busy.shape, 1 + (d + 1) + len(upper[0])))
            for b in batches:
                x, y, fold = _arrays(b, d)
                for r, f in zip(*np.nonzero(busy.any(2))):
                    own = fold[:, r] != f
                    a = np.column_stack([(x[own] - sets.mean[r, f]) * sets.scale[r, f], np.ones(own.sum())])
                    t = y[own]
                    w = sets.weight[r, f][t]
                    for j in np.flatnonzero(busy[r, f]):
                        eta = a @ beta[r, f, j]
                        p = 1 / (1 + np.exp(-eta))
                        h = (a * (w * p * (1 - p))[:, None]).T @ a
                        total[r, f, j] += np.concatenate([[(w * (np.logaddexp(0, eta) - t * eta)).sum()], (w * (p - t)) @ a, h[upper]])
            r, f, j = (x.astype(np.int32) for x in np.nonzero(busy))
            yield pa.RecordBatch.from_pydict({"repeat": r, "fold": f, "candidate": j, "sums": list(total[busy])})

        return sum_arrays(self.table.mapInArrow(run, "repeat int, fold int, candidate int, sums array<double>"), ["repeat", "fold", "candidate"], "sums")

    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the features as they are, and constants."""
        w = self.coefficients[..., :-1] * self.sets.scale[:, :, None, :]
        return w, self.coefficients[..., -1] - (w * self.sets.mean[:, :, None, :]).sum(-1)

    def out_of_fold(self, key: str) -> DataFrame:
        """candidate, repeat, fold, key, y and p: each row scored, once a repeat, by the models that did not see its group; one scan."""
        score, repeats = self._unseen()
        d, kind = len(self.features), self.table.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, _, fold = _arrays(b, d)
                for r in range(repeats):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r, np.int32)), pa.array(fold[:, r]), b.column(key), b.column("y"), _lists(score(x, fold, r))], names=["repeat", "fold", key, "y", "p"])

        scored = self.table.select(key, "y", "x", "fold").mapInArrow(run, f"repeat int, fold int, `{key}` {kind}, y int, p array<double>")
        return self._by_candidate(scored, ["repeat", "fold", key, "y"])

    def mean_scores(self, key: str) -> DataFrame:
        """candidate, key, y and p: the mean over the repeats of what out_of_fold() gives for a row, formed in the scan, so that repeats are not shuffled."""
        score, repeats = self._unseen()
        d, kind = len(self.features), self.table.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, _, fold = _arrays(b, d)
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("y"), _lists(sum(score(x, fold, r) for r in range(repeats)) / repeats)], names=[key, "y", "p"])

        return self._by_candidate(self.table.select(key, "y", "x", "fold").mapInArrow(run, f"`{key}` {kind}, y int, p array<double>"), [key, "y"])

    def _unseen(self) -> tuple[Callable[[np.ndarray, np.ndarray, int], np.ndarray], int]:
        """What scores rows, a column a candidate, by the models of a repeat that did not see them; and the number of repeats."""
        w, constant = self.raw()

        def score(x: np.ndarray, fold: np.ndarray, r: int) -> np.ndarray:
            eta = np.einsum("nd,ncd->nc", x, w[r][fold[:, r]]) + constant[r][fold[:, r]]
            return 1 / (1 + np.exp(-eta))

        return score, len(w)

    def _by_candidate(self, scored: DataFrame, keys: list[str]) -> DataFrame:
        names = F.array(*[F.lit(c.name) for c in self.candidates])
        return scored.select(*keys, F.posexplode("p").alias("c", "p")).select(F.get(names, F.col("c")).alias("candidate"), *keys, "p")
