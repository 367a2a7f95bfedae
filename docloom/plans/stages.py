"""The four stages as compositions of the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import MASK_TOKENS, EngineConfig, LanguageModelConfig, SplitConfig
from docloom.functions import encoding as E
from docloom.functions import labels as L
from docloom.functions import text as X
from docloom.operators import bpe, metrics, models, ngram_lm, profile
from docloom.operators.labels import collect_vocabulary, remap_labels
from docloom.operators.split import block_split, split_by_row_index


def flatten(
    documents: DataFrame, key: str = "row_idx", config: SplitConfig = SplitConfig(), dense: bool = False
) -> DataFrame:
    """Split, drop near-empty documents and put each text on one line; ``content`` becomes ``text``.

    The split comes first, so its ratios hold before the filter. ``key`` orders the documents, and
    ``dense`` says that it already numbers them from 0. Texts are not shuffled.
    """
    if dense:
        placed = split_by_row_index(documents, config, row_idx=key)
    else:
        placed = block_split(documents, key, config)
    kept = placed.where(X.has_min_content(F.col("content")))
    return kept.withColumn("text", X.newline_to_space(F.col("content"))).drop("content")


def prepare(
    documents: DataFrame,
    label_map: DataFrame | Mapping[str, str],
    key: str = "row_idx",
    config: SplitConfig = SplitConfig(),
    strict: bool = True,
    fold_case: bool = True,
    dense: bool = False,
) -> DataFrame:
    """:func:`flatten`, then replace the raw labels in ``buckets`` by the canonical ``labels``."""
    flat = flatten(documents, key, config, dense)
    return remap_labels(flat, label_map, strict=strict, fold_case=fold_case)


def rewrite(prepared: DataFrame, text: str = "text", repair_unicode: bool = True) -> DataFrame:
    """Add the cleaned ``lm_text`` in place of the text; the rest is kept."""
    return prepared.withColumn("lm_text", X.clean_text(F.col(text), repair_unicode)).drop(text)


def learn_vocabulary(corpus: DataFrame, config: LanguageModelConfig = LanguageModelConfig()) -> bpe.BytePairModel:
    """Learn the byte-pair vocabulary on the train split of a rewritten corpus."""
    counts = bpe.bpe_word_counts(corpus.where("split = 'train'"))
    return bpe.bpe_learn(counts, config.vocab_size, config.min_frequency, config.special_tokens)


def lm_examples(
    corpus: DataFrame,
    model: bpe.BytePairModel,
    key: str,
    config: LanguageModelConfig = LanguageModelConfig(),
    seed: int = 42,
) -> DataFrame:
    """Fixed-length, masked training rows: key, split, input_ids, attention_mask, labels."""
    rows = bpe.encode_examples(corpus.select(key, "split", "lm_text"), model, max_length=config.max_length)
    masked = E.mlm_mask(
        F.col("input_ids"),
        F.col(key),
        mask_id=model.special_tokens.index("<mask>"),
        vocab_size=model.first_merge_id + len(model.merges),
        special_count=len(model.special_tokens),
        probability=config.mlm_probability,
        seed=seed,
    )
    return rows.withColumn("masked", masked).select(
        key,
        "split",
        F.col("masked.input_id").alias("input_ids"),
        "attention_mask",
        F.col("masked.label").alias("labels"),
    )


def lm_score(corpus: DataFrame, k: float = 1.0, smoothing: str = "add_k") -> DataFrame:
    """Perplexity of the test split under a bigram model of the train split, ``add_k`` or ``kneser_ney``."""
    bigrams = ngram_lm.split_bigrams(corpus, X.tokenize_words(F.col("lm_text")))
    if smoothing not in ("add_k", "kneser_ney"):
        raise ValueError(f"unknown smoothing: {smoothing}")
    if smoothing == "add_k":
        return ngram_lm.ngram_perplexity(bigrams, k, ngram_lm.BOUNDARIES)
    return ngram_lm.kneser_ney_perplexity(bigrams)


def classifier_examples(
    prepared: DataFrame, model: bpe.BytePairModel, key: str, config: EngineConfig = EngineConfig()
) -> DataFrame:
    """Encoded text and multi-hot labels: key, split, input_ids, attention_mask, labels."""
    vocabulary = collect_vocabulary(prepared.select("labels"))
    rows = prepared.select(key, "split", "text", L.multi_hot(F.col("labels"), vocabulary).alias("labels"))
    return bpe.encode_examples(rows, model, "text", config.classifier.max_length)


def classify(
    prepared: DataFrame, family: str = "logistic_regression", config: EngineConfig = EngineConfig(), **options
) -> tuple[models.MultilabelModel, DataFrame]:
    """Fit on train; return the model and the predictions for dev and test with their truth."""
    vocabulary = collect_vocabulary(prepared.select("labels"))
    model = models.train_multilabel(prepared.where("split = 'train'"), vocabulary, family, **options)
    held_out = prepared.where("split in ('dev', 'test')").withColumn(
        "truth", L.multi_hot(F.col("labels"), vocabulary)
    )
    settings = config.classifier
    return model, models.predict_multilabel(
        held_out, model, threshold=settings.threshold, apply_sigmoid=settings.apply_sigmoid
    )


def score_predictions(predictions: DataFrame, split: str = "test") -> DataFrame:
    """The stored scores of the classifier stage."""
    return metrics.evaluate_multilabel(predictions.where(F.col("split") == split))


def census(corpus: DataFrame) -> DataFrame:
    """Mask tokens per split of a rewritten corpus."""
    return profile.special_token_census(corpus, MASK_TOKENS)
