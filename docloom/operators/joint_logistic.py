"""Logistic regression of many labels at once: one pass over the rows gives the gradients of all of them.

The labels share features and passes and nothing else. Each has its own quasi-Newton history and its own step,
moved in lockstep, so the result is that of one fit per label while the number of jobs does not depend on how many
labels there are. The rows are packed once and summed pass by pass; see ``packed_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.packed_rows import Moments, Rows, gradients, moments, pack

_HISTORY = 8
# Least share of the expected fall that a step has to bring, and how much a step that does not is shortened.
_ARMIJO, _SHORTER = 1e-4, 0.5


@dataclass(frozen=True)
class JointLogistic:
    """Weights, features by labels, and intercepts."""

    weights: np.ndarray
    intercepts: np.ndarray

    def scores(self, features: Column) -> Column:
        """Logits of a sparse feature vector as an array, by label; the model travels as a broadcast variable."""
        shared = SparkSession.getActiveSession().sparkContext.broadcast(self)

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared.value
            for batch in batches:
                vectors = pa.StructArray.from_arrays(batch.flatten(), fields=list(batch.type))
                rows = _Rows(vectors.field("indices"), vectors.field("values"), None)
                found = rows.scores(model.weights) + model.intercepts
                yield pa.array(list(found), pa.list_(pa.float64()))

        return score(F.unwrap_udt(features))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(-1, self.intercepts.tolist())]
        rows += [(int(i), self.weights[i].tolist()) for i in np.flatnonzero(self.weights.any(axis=1))]
        table = spark.createDataFrame(rows, "feature int, weights array<double>")
        table.withColumn("n_features", F.lit(len(self.weights))).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> JointLogistic:
        rows = spark.read.parquet(path).collect()
        weights = np.zeros((rows[0]["n_features"], len(rows[0]["weights"])))
        for row in rows:
            if row["feature"] >= 0:
                weights[row["feature"]] = row["weights"]
        return JointLogistic(weights, np.array(next(r["weights"] for r in rows if r["feature"] < 0)))


class _Rows(Rows):
    """Sparse rows of an Arrow batch."""

    def __init__(self, indices: pa.ListArray, values: pa.ListArray, scale: np.ndarray | None) -> None:
        at = indices.flatten().to_numpy(zero_copy_only=False)
        numbers = values.flatten().to_numpy(zero_copy_only=False)
        if scale is not None:
            numbers = numbers * scale[at]
        super().__init__(values.value_lengths().to_numpy(zero_copy_only=False), at, numbers)


class _Lockstep:
    """Limited-memory quasi-Newton steps of independent columns."""

    def __init__(self) -> None:
        self.steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale: np.ndarray | None = None

    def remember(self, moved: np.ndarray, change: np.ndarray, which: np.ndarray) -> None:
        """A step of the columns ``which`` and how it changed the gradient; the others take no part in it.

        Both arrays are kept, and changed for it.
        """
        del self.steps[: max(0, len(self.steps) + 1 - _HISTORY)]
        bent = np.einsum("ij,ij->j", moved, change)
        which = which & (bent > 1e-12)
        rho = np.where(which, 1 / np.where(which, bent, 1), 0)
        size = bent / np.maximum(np.einsum("ij,ij->j", change, change), 1e-300)
        self.scale = np.where(which, size, 1.0 if self.scale is None else self.scale)
        moved *= which
        change *= which
        self.steps.append((moved, change, rho))

    def direction(self, gradient: np.ndarray) -> np.ndarray:
        q, kept = gradient.copy(), []
        for moved, change, rho in reversed(self.steps):
            a = rho * np.einsum("ij,ij->j", moved, q)
            q -= a * change
            kept.append(a)
        if self.scale is not None:
            q *= self.scale
        for (moved, change, rho), a in zip(self.steps, reversed(kept)):
            q += (a - rho * np.einsum("ij,ij->j", change, q)) * moved
        return -q


def fit_joint(prepared: DataFrame, n_features: int, n_labels: int, reg: float = 0.01, max_passes: int = 60, tolerance: float = 1e-6) -> JointLogistic:
    """Fit all labels of ``prepared (features, truth)``, sparse vectors and 0/1 arrays, with a ridge penalty.

    Features are scaled to unit deviation, so the penalty is that of the scaled weights; intercepts are free. Each
    label must occur and be absent at least once. ``max_passes`` bounds the jobs; a label whose loss falls by less
    than ``tolerance`` of itself rests.
    """
    packed = pack(prepared)
    try:
        return fit_packed(packed, moments(packed, n_features, n_labels), range(n_labels), reg, max_passes, tolerance)
    finally:
        packed.unpersist()


def fit_packed(packed: DataFrame, known: Moments, labels: Sequence[int], reg: float = 0.01, max_passes: int = 60, tolerance: float = 1e-6) -> JointLogistic:
    """:func:`fit_joint` of some ``labels`` of packed rows whose moments are known."""
    labels = list(labels)
    scale = np.where(known.variance > 0, 1 / np.sqrt(np.where(known.variance > 0, known.variance, 1)), 0)[:, None]

    def evaluate(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Scaling the weights and the gradient is scaling the rows.
        loss, gradient = gradients(packed, known, np.multiply(at[:-1], scale, order="F"), at[-1], labels)
        gradient[:-1] *= scale
        gradient /= known.n
        gradient[:-1] += reg * at[:-1]
        return loss / known.n + 0.5 * reg * np.einsum("ij,ij->j", at[:-1], at[:-1]), gradient

    share = known.supports[labels] / known.n
    at = np.zeros((len(scale) + 1, len(labels)))
    at[-1] = np.log(share / (1 - share))
    value, gradient = evaluate(at)
    memory = _Lockstep()
    direction = memory.direction(gradient)
    step = 1 / np.maximum(1, np.sqrt(np.einsum("ij,ij->j", gradient, gradient)))
    resting = np.zeros(len(labels), bool)
    for _ in range(max_passes - 1):
        slope = np.einsum("ij,ij->j", gradient, direction)
        trial = at + np.where(resting, 0, step) * direction
        new_value, new_gradient = evaluate(trial)
        good = ~resting & (new_value <= value + _ARMIJO * step * slope)
        fall = value - new_value
        memory.remember((trial - at) * good, (new_gradient - gradient) * good, good)
        at, value, gradient = np.where(good, trial, at), np.where(good, new_value, value), np.where(good, new_gradient, gradient)
        resting |= good & (fall <= tolerance * np.maximum(1e-12, np.abs(value)))
        # A step too short to matter cannot help any more.
        resting |= ~good & (step < 1e-10)
        if resting.all():
            break
        direction = np.where(good, memory.direction(gradient), direction)
        step = np.where(good, 1.0, step * _SHORTER)
    return JointLogistic(at[:-1] * scale, at[-1])
