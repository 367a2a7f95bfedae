"""Multi-label baselines: one binary model per label of ``pyspark.ml``, or all labels in one fit, over shared features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import labels as L
from docloom.functions import text as X
from docloom.operators.joint_logistic import JointLogistic, fit_packed
from docloom.operators.logistic import fit_side_by_side
from docloom.operators.packed_rows import moments, pack

# Logit of a label that the train rows always or never carry.
_CERTAIN = 20.0


@dataclass(frozen=True)
class Family:
    """A baseline: its features, its estimator and how its raw output becomes a logit."""

    features: Callable[[int], list[Estimator]]
    estimator: Callable[[], Estimator]
    logit: Callable[[Column, Column | None], Column]
    n_features: int = 1 << 16


def _tf_idf(n_features: int) -> list:
    return [
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=n_features),
        IDF(inputCol="tf", outputCol="features", minDocFreq=2),
    ]


def _term_counts(n_features: int) -> list:
    return [HashingTF(inputCol="tokens", outputCol="features", numFeatures=n_features)]


# Size of averaged word vectors unless the caller names another, and the words that may each have one: the
# trainer holds all vectors on the driver, so words are hashed to a bounded number first.
VECTOR_SIZE = 100
VECTOR_WORDS = 1 << 17


def _word_vectors(n_features: int) -> list:
    cores = SparkSession.getActiveSession().sparkContext.defaultParallelism
    vectors = Word2Vec(inputCol="hashed", outputCol="features", vectorSize=n_features, minCount=2, seed=42)
    hashed = f"SELECT *, transform(tokens, t -> string(pmod(xxhash64(t), {VECTOR_WORDS}))) AS hashed FROM __THIS__"
    return [SQLTransformer(statement=hashed), vectors.setNumPartitions(cores)]


def _margin(raw: Column, _: Column | None) -> Column:
    return raw[1]


def _log_odds_of_joint(raw: Column, _: Column | None) -> Column:
    return raw[1] - raw[0]


def _log_odds_of_probability(_: Column, probability: Column | None) -> Column:
    p = F.least(F.greatest(probability[1], F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.ln(p / (1 - p))


# All labels are fitted at once; see ``joint_logistic``.
JOINT = "joint_logistic_regression"
# Each label has a fit of its own, and all fits share their passes; see ``logistic``.
SIDE_BY_SIDE = "logistic_regression"

FAMILIES = {
    JOINT: Family(_tf_idf, lambda: LogisticRegression(maxIter=20, regParam=0.01), _margin),
    SIDE_BY_SIDE: Family(_tf_idf, lambda: LogisticRegression(maxIter=20, regParam=0.01), _margin),
    "naive_bayes": Family(_term_counts, NaiveBayes, _log_odds_of_joint),
    "svm": Family(_tf_idf, lambda: LinearSVC(maxIter=20, regParam=0.01), _margin),
    "random_forest": Family(_tf_idf, lambda: RandomForestClassifier(numTrees=20, seed=42), _log_odds_of_probability),
    "boosted_trees": Family(_tf_idf, lambda: GBTClassifier(maxIter=10, seed=42), _log_odds_of_probability),
    "averaged_vectors": Family(_word_vectors, lambda: LogisticRegression(maxIter=20), _margin, VECTOR_SIZE),
}


@dataclass(frozen=True)
class MultilabelModel:
    """Feature stages and one model per label; a constant logit where the label never varied.

    In a joint fit the model of a label is its column in ``joint``.
    """

    family: str
    vocabulary: tuple[str, ...]
    features: PipelineModel
    models: tuple[Model | float | int, ...]
    joint: JointLogistic | None = None


def _with_tokens(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("tokens", F.transform(X.tokenize_words(F.coalesce(F.col(text), F.lit(""))), F.lower))


def train_multilabel(
    df: DataFrame,
    vocabulary: Sequence[str],
    family: str = "logistic_regression",
    text: str = "text",
    labels: str = "labels",
    n_features: int | None = None,
    parallelism: int = 4,
    estimator: Estimator | None = None,
) -> MultilabelModel:
    """Fit one binary model per label. The features are computed once and kept for all labels.

    The family ``joint_logistic_regression`` fits all labels together, in as many jobs whatever their number; so does
    ``logistic_regression`` with a fit per label, unless an ``estimator`` is given.

    ``n_features`` is the number of hashed terms, or the size of averaged vectors; it defaults to that of the
    family. In the other families ``parallelism`` labels are fitted at a time, each as a distributed job of its own,
    so the time grows with the number of labels.
    """
    chosen = FAMILIES[family]
    rows = _with_tokens(df.select(text, F.col(labels).alias("labels")), text).drop(text)
    truth = L.multi_hot(F.col("labels"), vocabulary).alias("truth")
    if family == JOINT or (family == SIDE_BY_SIDE and estimator is None):
        return _train_packed(rows, truth, vocabulary, family, n_features or chosen.n_features)
    features = Pipeline(stages=chosen.features(n_features or chosen.n_features)).fit(rows)
    prepared = features.transform(rows).select("features", truth).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = prepared.agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.col("truth")[i]).alias(f"s{i}") for i in range(len(vocabulary))]
        ).first()

        def fit(i: int) -> Model | float:
            if (certain := _constant(sums[f"s{i}"] or 0, sums["n"])) is not None:
                return certain
            target = prepared.select("features", F.col("truth")[i].cast("double").alias("label"))
            return (estimator.copy() if estimator is not None else chosen.estimator()).fit(target)

        with ThreadPool(max(1, min(parallelism, len(vocabulary)))) as pool:
            models = tuple(pool.map(fit, range(len(vocabulary))))
    finally:
        prepared.unpersist()
    return MultilabelModel(family, tuple(vocabulary), features, models)


def _constant(support: float, n: int) -> float | None:
    """The logit of a label that never varies."""
    return (_CERTAIN if support else -_CERTAIN) if support in (0, n) else None


def _train_packed(rows: DataFrame, truth: Column, vocabulary: Sequence[str], family: str, n_features: int) -> MultilabelModel:
    """All labels in shared passes over packed rows. The texts are read once, for the counts of their terms."""
    counter, weigher = FAMILIES[family].features(n_features)
    counted = counter.transform(rows).select(counter.getOutputCol(), truth).persist(StorageLevel.DISK_ONLY)
    packed = None
    try:
        features = PipelineModel([counter, weigher.fit(counted)])
        packed = pack(features.stages[1].transform(counted))
        known = moments(packed, n_features, len(vocabulary))
        counted.unpersist()
        constant = [_constant(support, known.n) for support in known.supports]
        varying = [i for i, certain in enumerate(constant) if certain is None]
        joint, fitted = None, []
        if varying and family == JOINT:
            joint, fitted = fit_packed(packed, known, varying), range(len(varying))
        elif varying:
            fitted = fit_side_by_side(packed, known, varying, FAMILIES[family].estimator())
    finally:
        counted.unpersist()
        if packed is not None:
            packed.unpersist()
    models = dict(zip(varying, fitted))
    return MultilabelModel(family, tuple(vocabulary), features, tuple(models.get(i, constant[i]) for i in range(len(vocabulary))), joint)


def predict_multilabel(
    df: DataFrame, model: MultilabelModel, text: str = "text", threshold: float = 0.5, apply_sigmoid: bool = False
) -> DataFrame:
    """Add ``scores`` (logits), ``pred`` (0/1 vector) and ``pred_labels`` to each row; no shuffle."""
    logit = FAMILIES[model.family].logit
    current = model.features.transform(_with_tokens(df, text))
    kept = [*df.columns, "features"]
    scores: list[Column] = []
    if model.joint is not None:
        current = current.select(*df.columns, model.joint.scores(F.col("features")).alias("_joint"))
        kept = [*df.columns, "_joint"]
    for i, one in enumerate(model.models):
        if isinstance(one, int):
            scores.append(F.col("_joint")[one])
            continue
        if isinstance(one, float):
            scores.append(F.lit(one))
            continue
        one = one.copy()
        one.setRawPredictionCol("_raw").setPredictionCol("_prediction")
        probability = None
        if one.hasParam("probabilityCol"):
            one.setProbabilityCol("_probability")
            probability = vector_to_array(F.col("_probability"))
        score = logit(vector_to_array(F.col("_raw")), probability)
        current = one.transform(current.select(*kept)).withColumn(f"_score{i}", score)
        kept.append(f"_score{i}")
        scores.append(F.col(f"_score{i}"))
    out = current.select(*df.columns, F.array(*scores).alias("scores"))
    pred = L.threshold_scores(F.col("scores"), threshold, apply_sigmoid)
    return out.withColumn("pred", pred).withColumn("pred_labels", L.decode_labels(F.col("pred"), model.vocabulary))


def save_model(spark: SparkSession, model: MultilabelModel, path: str) -> None:
    """Feature stages and label models in their own format, with a table that says which is which."""
    model.features.write().overwrite().save(f"{path}/features")
    if model.joint is not None:
        model.joint.save(spark, f"{path}/joint")
    rows = []
    for i, (label, one) in enumerate(zip(model.vocabulary, model.models)):
        constant = one if isinstance(one, float) else None
        if constant is None and not isinstance(one, int):
            PipelineModel([one]).write().overwrite().save(f"{path}/label-{i:05d}")
        rows.append((i, label, constant, model.family))
    schema = "idx int, label string, constant double, family string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{path}/labels")


def load_model(spark: SparkSession, path: str) -> MultilabelModel:
    schema = "idx int, label string, constant double, family string"
    rows = spark.read.schema(schema).json(f"{path}/labels").orderBy("idx").collect()
    features = PipelineModel.load(f"{path}/features")
    if rows[0]["family"] == JOINT:
        columns = iter(range(len(rows)))
        placed = tuple(next(columns) if r["constant"] is None else r["constant"] for r in rows)
        joint = JointLogistic.load(spark, f"{path}/joint") if any(isinstance(m, int) for m in placed) else None
        return MultilabelModel(JOINT, tuple(r["label"] for r in rows), features, placed, joint)
    loaded = tuple(
        PipelineModel.load(f"{path}/label-{r['idx']:05d}").stages[0] if r["constant"] is None else r["constant"]
        for r in rows
    )
    return MultilabelModel(rows[0]["family"], tuple(r["label"] for r in rows), features, loaded)
