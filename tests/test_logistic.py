import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from docloom.operators.logistic import fit_side_by_side
from docloom.operators.packed_rows import moments, pack
from tests.test_joint_logistic import frame, jobs_of, table


@pytest.mark.parametrize("iterations, reg", [(20, 0.01), (3, 0.0), (100, 1.0)])
def test_fits_side_by_side_are_those_of_the_library(spark, iterations, reg):
    x, truth = table(150, 12, 4)
    # A feature without deviation, labels of very different shares and one that a feature gives away.
    x[:, 4] = 3
    truth[:, 1] = x[:, 5] > 0
    truth[:, 2] = np.arange(150) % 50 == 0
    df = frame(spark, x, truth).cache()
    estimator = LogisticRegression(maxIter=iterations, regParam=reg)
    packed = pack(df)
    fitted = fit_side_by_side(packed, moments(packed, 12, 4), [0, 1, 2], estimator)
    packed.unpersist()
    for label, model in enumerate(fitted):
        own = estimator.fit(df.select("features", F.col("truth")[label].cast("double").alias("label")))
        np.testing.assert_allclose(model.coefficients.toArray(), own.coefficients.toArray(), rtol=1e-6, atol=1e-8)
        assert model.intercept == pytest.approx(own.intercept, rel=1e-6)
        assert model.numClasses == 2 and model.getRegParam() == reg and model.numFeatures == 12


def test_jobs_do_not_grow_with_the_labels(spark):
    x, truth = table(60, 12, 1)
    n = []
    for k in (2, 16):
        packed = pack(frame(spark, x, np.repeat(truth, k, axis=1)))
        known = moments(packed, 12, k)
        n.append(jobs_of(spark, f"side{k}", lambda: fit_side_by_side(packed, known, range(k), LogisticRegression(maxIter=20, regParam=0.01))))
        packed.unpersist()
    assert n[0] == n[1] > 5
