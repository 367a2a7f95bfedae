"""Multi-label metrics and perplexity.

Inputs are one row per document with ``truth`` and ``pred`` as 0/1 vectors (and ``scores`` for the
loss), so nothing is shuffled but a few numbers per label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Division in which a zero denominator gives 0."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def binary_cross_entropy(score: Column, truth: Column) -> Column:
    """Binary cross-entropy of a logit, without overflow."""
    return F.greatest(score, F.lit(0.0)) - score * truth + F.log1p(F.exp(-F.abs(score)))


def label_confusion(df: DataFrame) -> DataFrame:
    """``(idx, tp, fp, fn, support)`` per label position."""
    return _confusion(_cells(df))


def _cells(df: DataFrame, *extra: Column) -> DataFrame:
    """One row per document and label position; long but never shuffled as such."""
    return df.select(F.posexplode(F.arrays_zip("truth", "pred", *extra)).alias("idx", "cell")).select(
        "idx", "cell.*"
    )


def _confusion(cells: DataFrame, *more: Column) -> DataFrame:
    t, p = F.col("truth").cast("long"), F.col("pred").cast("long")
    return cells.groupBy("idx").agg(
        F.sum(t * p).alias("tp"),
        F.sum((1 - t) * p).alias("fp"),
        F.sum(t * (1 - p)).alias("fn"),
        F.sum(t).alias("support"),
        *more,
    )


def _weighted(name: str, value: Column) -> Column:
    return _ratio(F.sum(F.col("support") * value), F.sum("support")).alias(name)


def _prf_columns() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [
        _weighted("precision", _ratio(tp, tp + fp)),
        _weighted("recall", _ratio(tp, tp + fn)),
        _weighted("f1", _ratio(2 * tp, 2 * tp + fp + fn)),
    ]


def weighted_prf(confusion: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1 in one row."""
    return confusion.agg(*_prf_columns())


def subset_accuracy(df: DataFrame) -> DataFrame:
    """Share of rows whose whole label vector is right."""
    return df.agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))


def multilabel_loss(df: DataFrame) -> DataFrame:
    """Mean binary cross-entropy over all cells; ``scores`` are logits."""
    cell = F.zip_with("scores", "truth", binary_cross_entropy)
    total = F.aggregate(cell, F.lit(0.0), lambda a, x: a + x)
    return df.agg(_ratio(F.sum(total), F.sum(F.size("scores"))).alias("loss"))


def evaluate_multilabel(df: DataFrame) -> DataFrame:
    """``f1, accuracy, precision, recall, loss`` in one row from one pass over the documents.

    Whole-row matches ride on the cell of position 0, so that no second pass is needed.
    """
    exact = F.col("truth") == F.col("pred")
    marks = F.transform("truth", lambda _, i: F.when(i == 0, exact.cast("long")).otherwise(F.lit(0)))
    rows = df.select("truth", "pred", "scores", marks.alias("exact"))
    cells = _cells(rows, F.col("scores"), F.col("exact"))
    per_label = _confusion(
        cells,
        F.sum("exact").alias("exact"),
        F.count(F.lit(1)).alias("cells"),
        F.sum(binary_cross_entropy(F.col("scores"), F.col("truth"))).alias("loss"),
    )
    documents = F.max(F.when(F.col("idx") == 0, F.col("cells")))
    precision, recall, f1 = _prf_columns()
    return per_label.agg(
        f1,
        _ratio(F.sum("exact"), documents).alias("accuracy"),
        precision,
        recall,
        _ratio(F.sum("loss"), F.sum("cells")).alias("loss"),
    )


def micro_fbeta(df: DataFrame, expected: str = "expected", out: str = "out") -> DataFrame:
    """Corpus-level F1 and F2 of label sets given as arrays."""
    hits = F.size(F.array_intersect(expected, out)).cast("long")
    sums = df.agg(
        F.sum(hits).alias("tp"),
        F.sum(F.size(F.array_distinct(expected)).cast("long")).alias("n_true"),
        F.sum(F.size(F.array_distinct(out)).cast("long")).alias("n_pred"),
    )

    def fbeta(beta: float) -> Column:
        # (1+b2)PR/(b2 P+R) with P = tp/n_pred and R = tp/n_true
        b2 = beta * beta
        return _ratio((1 + b2) * F.col("tp"), b2 * F.col("n_true") + F.col("n_pred"))

    return sums.select(fbeta(1.0).alias("f1"), fbeta(2.0).alias("f2"))


def line_accuracy(df: DataFrame, expected: str = "expected", out: str = "out") -> DataFrame:
    """Share of rows whose label lines agree as sets; label order in a line has no meaning."""
    same = F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(out))
    return df.agg(F.avg(same.cast("double")).alias("accuracy"))


def perplexity(df: DataFrame, loss: str = "loss") -> DataFrame:
    """``perplexity`` and ``eval_loss`` from a table of losses; nulls do not count."""
    return df.agg(F.avg(loss).alias("eval_loss")).select(F.exp("eval_loss").alias("perplexity"), "eval_loss")
