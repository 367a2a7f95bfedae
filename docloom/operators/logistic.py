"""The fits of ``pyspark.ml``'s binary logistic regression for many labels, side by side over packed rows.

Every label has its own optimiser, that of the library: limited-memory quasi-Newton steps with a line search for the
strong Wolfe conditions, on features scaled to unit deviation and centred, with its bounds and its rules to stop. All of
them ask for the loss at a point of their own at a time, and one pass over the rows answers all that still run, where
a fit of its own would read the rows again for every label. Weights are those of the library but for rounding.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Generator, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

from docloom.operators.packed_rows import Moments, gradients

# As the library has them: steps remembered, values looked back at, tries of a line search and of its zoom, and the
# constants of the Wolfe conditions.
_HISTORY, _LOOK_BACK, _TRIES, _FALL, _BEND = 10, 20, 10, 1e-4, 0.9

Asked = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


class _NoStep(Exception):
    """No step along a direction, or no direction."""


def _direction(gradient: np.ndarray, steps: deque) -> np.ndarray:
    out, kept = gradient.copy(), []
    size = 1.0
    if steps:
        moved, change = steps[-1]
        bent = moved @ change
        if not bent >= 0:
            raise _NoStep
        size = bent / (change @ change)
    for moved, change in reversed(steps):
        rho = moved @ change
        a = moved @ out / rho
        if np.isnan(a):
            raise _NoStep
        out -= a * change
        kept.append((a, rho))
    out *= size
    for (moved, change), (a, rho) in zip(steps, reversed(kept)):
        out += (a - change @ out / rho) * moved
    return -out


def _between(low: tuple, high: tuple) -> float:
    """The least point of the cubic through two steps ``(step, value, slope)``, away from both ends."""
    if low[0] > high[0]:
        low, high = high, low
    (s, v, d), (t, w, e) = low, high
    first = d + e - 3 * (v - w) / (s - t)
    second = np.sqrt(first * first - d * e)
    found = t - (t - s) * (e + second - first) / (e - d + 2 * second)
    least, most = s + 0.1 * (t - s), s + 0.9 * (t - s)
    return least if found < least else most if found > most else found


def _line_search(at: np.ndarray, value: float, gradient: np.ndarray, direction: np.ndarray, step: float):
    """The first step found that keeps the strong Wolfe conditions, with value and gradient there."""
    slope = gradient @ direction
    if slope > 0:
        raise _NoStep
    low, high = (0.0, value, slope), None
    for i in range(_TRIES):
        new_value, new_gradient = yield at + direction * step
        here = (step, new_value, new_gradient @ direction)
        if not np.isfinite(new_value):
            step /= 2
            continue
        if new_value > value + _FALL * step * slope or (new_value >= low[1] and i > 0):
            high = here
            break
        if abs(here[2]) <= _BEND * abs(slope):
            return step, new_value, new_gradient
        if here[2] >= 0:
            low, high = here, low
            break
        low, step = here, step * 1.5
    if high is None:
        raise _NoStep
    for _ in range(_TRIES):
        step = _between(low, high)
        new_value, new_gradient = yield at + direction * step
        here = (step, new_value, new_gradient @ direction)
        if new_value > value + _FALL * step * slope or new_value >= low[1]:
            high = here
            continue
        if abs(here[2]) <= _BEND * abs(slope):
            return step, new_value, new_gradient
        if here[2] * (high[0] - low[0]) >= 0:
            high = low
        low = here
    raise _NoStep


def minimise(at: np.ndarray, iterations: int, tolerance: float) -> Asked:
    """Yields points, is sent their ``(value, gradient)`` and returns the least point found."""
    value, gradient = yield at
    start, done, failed = abs(value), 0, False
    steps, values = deque(maxlen=_HISTORY), deque([np.inf], maxlen=_LOOK_BACK)
    with np.errstate(all="ignore"):
        while done < iterations:
            if len(values) >= 2 and abs(value - max(values)) <= tolerance * start:
                break
            if np.linalg.norm(gradient) <= max(tolerance * abs(value), 1e-8):
                break
            try:
                direction = _direction(gradient, steps)
                first = 1.0 if done else 1 / np.linalg.norm(direction)
                step, new_value, new_gradient = yield from _line_search(at, value, gradient, direction, first)
                if step * np.linalg.norm(gradient) < 1e-10:
                    raise _NoStep
            except _NoStep:
                if failed:
                    break
                # Once more along the gradient.
                failed = True
                steps.clear()
                continue
            moved = at + direction * step
            steps.append((moved - at, new_gradient - gradient))
            at, value, gradient = moved, new_value, new_gradient
            values.append(value)
            done, failed = done + 1, False
    return at


def fit_side_by_side(packed: DataFrame, known: Moments, labels: Sequence[int], estimator: LogisticRegression) -> list[LogisticRegressionModel]:
    """One model per label in ``labels``, as ``estimator``, with a ridge penalty and an intercept, would fit it.

    Each label must occur and be absent at least once.
    """
    scale = np.where(known.variance > 0, 1 / np.sqrt(np.where(known.variance > 0, known.variance, 1)), 0)
    centre, reg = known.mean * scale, estimator.getRegParam()
    fits, asked, found = {}, {}, {}
    for label in labels:
        at = np.zeros(len(scale) + 1)
        at[-1] = np.log(known.supports[label] / (known.n - known.supports[label]))
        fits[label] = minimise(at, estimator.getMaxIter(), estimator.getTol())
        asked[label] = next(fits[label])
    while asked:
        running = list(asked)
        points = np.stack([asked[label] for label in running], axis=1)
        intercepts = points[-1] - centre @ points[:-1]
        loss, sums = gradients(packed, known, points[:-1] * scale[:, None], intercepts, running)
        for i, label in enumerate(running):
            weights = asked[label][:-1]
            gradient = np.append(scale * sums[:-1, i] - centre * sums[-1, i], sums[-1, i]) / known.n
            gradient[:-1] += reg * weights
            value = loss[i] / known.n + 0.5 * reg * (weights @ weights)
            try:
                asked[label] = fits[label].send((value, gradient))
            except StopIteration as end:
                found[label] = end.value
                del asked[label]
    return [_model(estimator, found[label][:-1] * scale, found[label][-1] - centre @ found[label][:-1]) for label in labels]


def _model(estimator: LogisticRegression, weights: np.ndarray, intercept: float) -> LogisticRegressionModel:
    context = SparkSession.getActiveSession().sparkContext
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    vector = _py2java(context, Vectors.dense(weights)).compressed()
    return estimator._copyValues(LogisticRegressionModel(made(LogisticRegression().uid, vector, float(intercept))))
