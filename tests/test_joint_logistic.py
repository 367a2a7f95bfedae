import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from docloom.operators.joint_logistic import JointLogistic, _Rows, fit_joint


def table(n, d, labels, seed=1):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, d)) < 0.3, rng.integers(1, 5, (n, d)), 0).astype(float)
    x[:, 3] = 0
    truth = (x @ rng.normal(size=(d, labels)) + rng.normal(size=(n, labels)) > 0.5).astype(int)
    return x, truth


def frame(spark, x, truth):
    rows = [(Vectors.sparse(x.shape[1], [(int(j), float(r[j])) for j in np.flatnonzero(r)]), t.tolist()) for r, t in zip(x, truth)]
    return spark.createDataFrame(rows, ["features", "truth"]).repartition(3)


def slow_fit(x, truth, reg):
    """Newton's method on the dense table, one label after the other."""
    deviation = x.std(axis=0, ddof=1)
    scaled = np.where(deviation > 0, x / np.where(deviation > 0, deviation, 1), 0)
    full = np.hstack([scaled, np.ones((len(x), 1))])
    penalty = np.diag([reg] * x.shape[1] + [0.0])
    out = []
    for y in truth.T:
        w = np.zeros(full.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-full @ w))
            gradient = full.T @ (p - y) / len(x) + penalty @ w
            hessian = (full * (p * (1 - p))[:, None]).T @ full / len(x) + penalty + 1e-12 * np.eye(len(w))
            w -= np.linalg.solve(hessian, gradient)
        out.append(w)
    out = np.array(out).T
    return np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0)[:, None] * out[:-1], out[-1]


def test_joint_fit_equals_newtons_method(spark):
    x, truth = table(120, 12, 5)
    model = fit_joint(frame(spark, x, truth), 12, 5, reg=0.02, max_passes=300, tolerance=1e-13)
    weights, intercepts = slow_fit(x, truth, 0.02)
    np.testing.assert_allclose(model.weights, weights, atol=2e-4)
    np.testing.assert_allclose(model.intercepts, intercepts, atol=2e-3)
    assert (model.weights[3] == 0).all()


def test_scores_and_saved_weights(spark, tmp_path):
    x, truth = table(30, 12, 3)
    model = JointLogistic(np.arange(36.0).reshape(12, 3) - 17, np.array([1.0, -2.0, 0.5]))
    df = frame(spark, x, truth).withColumn("scores", model.scores(F.col("features")))
    for row in df.collect():
        np.testing.assert_allclose(row["scores"], row["features"].toArray() @ model.weights + model.intercepts)
    model.save(spark, str(tmp_path / "m"))
    again = JointLogistic.load(spark, str(tmp_path / "m"))
    assert (again.weights == model.weights).all() and (again.intercepts == model.intercepts).all()


def test_a_pass_is_that_of_the_dense_table_and_holds_the_terms_once():
    rng = np.random.default_rng(5)
    x = np.where(rng.random((400, 1000)) < 0.3, rng.random((400, 1000)), 0)
    x[[0, 7, 399]] = 0
    at = [np.flatnonzero(r) for r in x]
    whole = pa.array([[]] + [a.tolist() for a in at], pa.list_(pa.int32())), pa.array([[]] + [r[a].tolist() for r, a in zip(x, at)], pa.list_(pa.float64()))
    weights, errors, into = rng.normal(size=(1000, 16)), rng.normal(size=(400, 16)), np.ones((1000, 16))
    rows = _Rows(whole[0].slice(1), whole[1].slice(1), None)
    terms = len(rows.at) * 16 * 8
    tracemalloc.start()
    np.testing.assert_allclose(rows.scores(weights), x @ weights)
    first = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    rows.gradient(errors, into)
    second = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    np.testing.assert_allclose(into, 1 + x.T @ errors)
    assert first < 1.5 * terms and second < 0.5 * terms


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_labels(spark):
    x, truth = table(60, 12, 1)
    small, large = (frame(spark, x, np.repeat(truth, k, axis=1)).cache() for k in (2, 16))
    small.count(), large.count()
    n = [jobs_of(spark, f"joint{k}", lambda: fit_joint(df, 12, k)) for k, df in ((2, small), (16, large))]
    assert n[0] == n[1] > 5
