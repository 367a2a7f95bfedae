import math

import numpy as np
import pytest
from pyspark.ml.evaluation import MultilabelClassificationEvaluator
from pyspark.sql import functions as F

from docloom.catalog import views
from docloom.operators import metrics as M


def frame(spark, truth, scores):
    rows = [([int(x) for x in t], [float(x) for x in s], [int(x >= 0.5) for x in s]) for t, s in zip(truth, scores)]
    return spark.createDataFrame(rows, "truth array<int>, scores array<double>, pred array<int>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    truth = (rng.random((60, 5)) < 0.4).astype(int)
    truth[:, 4] = 0  # a label without support
    scores = truth * 1.2 + rng.normal(0, 0.6, truth.shape)
    scores[:, 3] = -1  # a label that is never predicted
    return truth, scores


def by_hand(truth, scores):
    pred = (scores >= 0.5).astype(int)
    tp, fp, fn = (truth * pred).sum(0), ((1 - truth) * pred).sum(0), (truth * (1 - pred)).sum(0)
    support = truth.sum(0)
    div = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b != 0)
    weight = support / support.sum()
    loss = np.maximum(scores, 0) - scores * truth + np.log1p(np.exp(-np.abs(scores)))
    return {
        "precision": (weight * div(tp, tp + fp)).sum(),
        "recall": (weight * div(tp, tp + fn)).sum(),
        "f1": (weight * div(2.0 * tp, 2 * tp + fp + fn)).sum(),
        "accuracy": (truth == pred).all(1).mean(),
        "loss": loss.mean(),
    }


def test_all_scores_in_one_pass_and_apart(spark, data):
    df = frame(spark, *data)
    expected = by_hand(*data)
    assert M.evaluate_multilabel(df).first().asDict() == pytest.approx(expected)
    apart = M.weighted_prf(M.label_confusion(df)).first().asDict()
    apart |= M.subset_accuracy(df).first().asDict() | M.multilabel_loss(df).first().asDict()
    assert apart == pytest.approx(expected)
    assert list(M.evaluate_multilabel(df).columns) == ["f1", "accuracy", "precision", "recall", "loss"]


def test_against_the_evaluator_of_spark(spark, data):
    df = frame(spark, *data)
    hot = lambda c: F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: F.get(c, i) == 1), lambda i: i.cast("double"))
    sets = df.select(hot(F.col("truth")).alias("label"), hot(F.col("pred")).alias("prediction"))
    theirs = lambda name: MultilabelClassificationEvaluator(metricName=name).evaluate(sets)
    assert M.subset_accuracy(df).first()[0] == pytest.approx(theirs("subsetAccuracy"))
    ours = M.micro_fbeta(sets, "label", "prediction").first()
    assert ours["f1"] == pytest.approx(theirs("microF1Measure"))
    p, r = theirs("microPrecision"), theirs("microRecall")
    assert ours["f2"] == pytest.approx(5 * p * r / (4 * p + r))


def test_lines_compare_as_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"]), ([], []), (["a"], ["b"]), (["a"], [])], "expected array<string>, out array<string>")
    assert M.line_accuracy(df).first()[0] == 0.5


def test_nothing_true_or_predicted(spark):
    df = frame(spark, [[0, 0]], [[0.0, 0.0]])
    assert M.weighted_prf(M.label_confusion(df)).first().asDict() == {"precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_perplexity_skips_nulls(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "loss double")
    row = M.perplexity(df).first()
    assert row["eval_loss"] == 2.0 and row["perplexity"] == pytest.approx(math.exp(2))


def test_values_on_the_given_tables(spark):
    df = views.label_vectors(spark, "/root/testdata/sf0.01")
    row = M.evaluate_multilabel(df).first()
    expected = {"precision": 0.803522, "recall": 0.953373, "f1": 0.861298, "accuracy": 0.39898, "loss": 0.508845}
    assert row.asDict() == pytest.approx(expected, abs=1e-6)
