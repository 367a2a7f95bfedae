import pytest
from pyspark.sql import functions as F

from docloom.operators import models
from docloom.plans import stages

VOCABULARY = ["always", "animals", "food", "never"]


@pytest.fixture(scope="module")
def docs(spark):
    kinds = {"animals": "cat dog bird horse", "food": "bread soup cheese apple"}
    rows = []
    for i in range(160):
        labels = ["always"]
        words = ["common", f"w{i % 7}"]
        # None, the first, the second or both of the varying labels.
        for j, (label, text) in enumerate(kinds.items()):
            if i >> j & 1:
                labels.append(label)
                words += text.split()
        rows.append((i, " ".join(words), labels, "train" if i % 5 else "test"))
    return spark.createDataFrame(rows, "row_idx long, text string, labels array<string>, split string").cache()


@pytest.mark.parametrize("family", sorted(models.FAMILIES))
def test_each_family_learns_separable_labels(docs, family):
    model = models.train_multilabel(docs.where("split = 'train'"), VOCABULARY, family, n_features=64)
    predicted = models.predict_multilabel(docs.where("split = 'test'"), model, threshold=0.0)
    assert set(docs.columns) < set(predicted.columns)
    right = total = 0
    for row in predicted.collect():
        assert len(row["scores"]) == len(row["pred"]) == 4
        assert "always" in row["pred_labels"] and "never" not in row["pred_labels"]
        right += sorted(row["pred_labels"]) == sorted(row["labels"])
        total += 1
    assert right / total > 0.9


def test_stage_scores_and_saved_model(spark, docs, tmp_path):
    model, predictions = stages.classify(docs, "naive_bayes", n_features=64)
    scores = stages.score_predictions(predictions).first().asDict()
    assert scores["f1"] > 0.9 and scores["accuracy"] > 0.9
    models.save_model(spark, model, str(tmp_path / "m"))
    again = models.predict_multilabel(docs.where("split = 'test'"), models.load_model(spark, str(tmp_path / "m")))
    same = again.join(predictions.select("row_idx", F.col("scores").alias("s")), "row_idx")
    assert same.where("scores <> s").count() == 0 and same.count() == 32
