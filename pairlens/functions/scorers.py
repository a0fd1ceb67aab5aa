"""Scorers: a score of a pair and the confidence in it, struct<score: double, confidence: double>.

A batch scorer is a function over Arrow batches.  What it needs to score, a
model or a table of weights, is loaded once in each Python worker, however many
tasks and batches the worker gets, and a batch that fails as a whole is scored
row by row.  A row with a null input, or one whose own scoring fails, gets the
neutral score, in which there is no confidence.  Scores are cut to [0, 1].

Linear scorers also have a form without Python, a column expression.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Without evidence: the middle, and no confidence.
NEUTRAL_SCORE, NEUTRAL_CONFIDENCE = 0.5, 0.0
SCORED = "score double, confidence double"
ARROW = pa.struct([("score", pa.float64()), ("confidence", pa.float64())])
_LOADED: dict[str, Any] = {}


@dataclass(frozen=True)
class Scorer:
    """load() gives the parameters; many(parameters, columns) scores and confidences of a batch; one(parameters, values) those of a row.

    Without one(), a batch that fails is an error.
    """

    load: Callable[[], Any]
    many: Callable[[Any, list[pa.Array]], tuple[np.ndarray, np.ndarray]]
    one: Callable[[Any, tuple], tuple[float, float]] | None = None
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def parameters(self) -> Any:
        if self.token not in _LOADED:
            _LOADED[self.token] = self.load()
        return _LOADED[self.token]

    def score(self, columns: list[pa.Array]) -> pa.Array:
        """Scores of one batch, whose columns are of one length."""
        if len({len(c) for c in columns}) != 1:
            raise ValueError("columns of a batch differ in length")
        given = np.ones(len(columns[0]), bool)
        for c in columns:
            given &= np.asarray(c.is_valid())
        score, confidence = np.full(len(given), NEUTRAL_SCORE), np.full(len(given), NEUTRAL_CONFIDENCE)
        at = np.flatnonzero(given)
        if len(at):
            score[at], confidence[at] = self._rows([c.take(pa.array(at)) for c in columns])
        bad = ~np.isfinite(score) | ~np.isfinite(confidence)
        score[bad], confidence[bad] = NEUTRAL_SCORE, NEUTRAL_CONFIDENCE
        return pa.StructArray.from_arrays([pa.array(score.clip(0, 1)), pa.array(confidence.clip(0, 1))], fields=list(ARROW))

    def _rows(self, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        parameters = self.parameters()
        try:
            score, confidence = self.many(parameters, columns)
            if len(score) != len(columns[0]) or len(confidence) != len(columns[0]):
                raise ValueError("a batch has as many scores as rows")
            return np.asarray(score, float), np.asarray(confidence, float)
        except Exception:
            if self.one is None:
                raise
        out = np.tile([NEUTRAL_SCORE, NEUTRAL_CONFIDENCE], (len(columns[0]), 1))
        for i, row in enumerate(zip(*[c.to_pylist() for c in columns])):
            try:
                out[i] = self.one(parameters, row)
            except Exception:  # this row stays neutral
                continue
        return out[:, 0], out[:, 1]


def batch_scorer(scorer: Scorer) -> Callable[..., Column]:
    """scorer as a function of columns."""

    @F.arrow_udf(SCORED)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:  # one column comes bare
            yield scorer.score(list(columns) if isinstance(columns, tuple) else [columns])

    return run


def scalar_scorer(one: Callable[..., tuple[float, float]], load: Callable[[], Any] = lambda: None) -> Callable[..., Column]:
    """A function of the values of one row as a function of columns; it runs on Arrow batches all the same."""

    def many(parameters: Any, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        rows = [one(*row) if parameters is None else one(parameters, *row) for row in zip(*[c.to_pylist() for c in columns])]
        return tuple(np.asarray(rows, float).reshape(-1, 2).T)

    return batch_scorer(Scorer(load, many, lambda parameters, row: one(*row) if parameters is None else one(parameters, *row)))


def register(spark: SparkSession, name: str, scorer: Callable[..., Column]) -> None:
    """scorer under a name in SQL: SELECT name(a, b).score."""
    spark.udf.register(name, scorer)


@dataclass(frozen=True)
class Linear:
    """A logistic score of named features; confidence is how decided it is, times how much evidence there is (full evidence: 1)."""

    weights: dict[str, float]
    bias: float
    full_evidence: float = 20.0

    def scorer(self, spark: SparkSession) -> Scorer:
        """Of two columns: the features in the order of weights, as an array, and the evidence."""
        shared = spark.sparkContext.broadcast((list(self.weights.values()), self.bias, self.full_evidence))  # a number for each feature

        def load() -> tuple[np.ndarray, float, float]:
            w, bias, full = shared.value
            return np.asarray(w, float), bias, full

        def many(parameters: tuple, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
            w, bias, full = parameters
            lists, evidence = columns
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            score = 1 / (1 + np.exp(-(x @ w + bias)))
            return score, np.abs(2 * score - 1) * np.minimum(1, evidence.to_numpy(zero_copy_only=False) / full)

        def one(parameters: tuple, row: tuple) -> tuple[float, float]:
            w, bias, full = parameters
            score = 1 / (1 + np.exp(-(np.dot(np.asarray(row[0], float), w) + bias)))
            return score, abs(2 * score - 1) * min(1, row[1] / full)

        return Scorer(load, many, one)

    def column(self, features: Column, evidence: Column) -> Column:
        """The same as an expression."""
        w = F.array(*[F.lit(x) for x in self.weights.values()])
        dot = F.aggregate(F.zip_with(features, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        score = 1 / (1 + F.exp(-(dot + self.bias)))
        ok = F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x)) & evidence.isNotNull()
        confidence = F.abs(2 * score - 1) * F.least(F.lit(1.0), evidence / self.full_evidence)
        return F.struct(F.when(ok, score).otherwise(NEUTRAL_SCORE).alias("score"), F.when(ok, confidence).otherwise(NEUTRAL_CONFIDENCE).alias("confidence"))
