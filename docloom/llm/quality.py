"""Quality by importance resampling: two hashed n-gram models and a Gumbel top-k.

The raw model counts the n-grams of all documents, the target model those of documents labelled good. A
document's weight is the ratio of the two models on its text. Keeping the k documents with the largest
log-weight plus Gumbel noise draws k documents without replacement in proportion to their weights.

Counts come as one row per hash bucket and task, are summed by bucket, and reach the driver as two arrays
of fixed length. Texts are never shuffled: the models and the cut are broadcast to them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stable_sample, text_bytes, uniform
from docloom.operators.row_index import global_row_index
from docloom.session import materialize

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
# Labelled rows used at most, and the share of them that the target model learns from; the rest calibrates.
LABELLED_ROWS = 20_000
TARGET_SHARE = 0.75
# Pseudo-counts, per bucket on average, that draw the target model towards the raw one.
PRIOR = 4.0
# A weight is that of a stretch of so many n-grams, so that long texts do not outweigh all others.
STRETCH = 100.0
# Share of the held-back good documents that must stay.
RECALL = 0.999
SEED = 7

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x200-9a-z\x80-\xff]+")
# Fixed odd multipliers of the hash.
_MIX, _LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def hashed_ngrams(text: bytes) -> np.ndarray:
    """Buckets of the lower-cased words, marks and pairs of neighbours of a whole text, repeats included."""
    tokens = _TOKEN.findall(text.lower())
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    pairs = h[:-1] * _LEFT + h[1:] * _RIGHT
    return (np.concatenate([h, pairs]) * _MIX >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    """Log ratio per bucket and the least weight of an accepted document; None: nothing is rejected."""

    log_ratio: np.ndarray
    least_weight: float | None

    def log_weight(self, text: bytes) -> float:
        grams = hashed_ngrams(text)
        return float(self.log_ratio[grams].mean() * STRETCH) if len(grams) else 0.0


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(body, doc_id, part)``: part is target, good, bad or null; at most ``rows`` labels are broadcast.

    A document labelled both ways counts as bad.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    target = uniform("doc_id", seed=SEED) < TARGET_SHARE
    part = F.when(F.col("q") == 0, "bad").when(target, "target").otherwise("good")
    few = stable_sample(known, rows, "doc_id", SEED).select(F.col("doc_id").alias("known_id"), part.alias("part"))
    body = docs.select("doc_id", text_bytes().alias("body"))
    return body.join(F.broadcast(few), F.col("doc_id") == F.col("known_id"), "left").select("doc_id", "body", "part")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    none = np.zeros(0, np.int64)
    for batch in batches:
        seen, wanted = [none], [none]
        for body, part in zip(batch.column("body").to_pylist(), batch.column("part").to_pylist()):
            grams = hashed_ngrams(body)
            seen.append(grams)
            if part == "target":
                wanted.append(grams)
        raw += np.bincount(np.concatenate(seen), minlength=BUCKETS)
        target += np.bincount(np.concatenate(wanted), minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def _with_weight(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [model.value.log_weight(b) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_given"), pa.array(weights, pa.float64())], names=["_given", "log_weight"])

    return run


def weighted(rows: DataFrame, body: Column, model: QualityModel, leave: tuple[str, ...] = ()) -> DataFrame:
    """``(row, log_weight)``: the columns of ``rows`` but those in ``leave``, and the weight of ``body``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    given = rows.select(F.struct(*[c for c in rows.columns if c not in leave]).alias("_given"), body.alias("body"))
    return given.mapInArrow(_with_weight(shared), given.select("_given", F.lit(0.0).alias("log_weight")).schema)


def fit_quality(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, recall: float = RECALL) -> QualityModel:
    """Learn both models over all documents, and the weight that ``recall`` of held-back good documents reach.

    Without labels of good documents, or none to calibrate on, nothing is rejected.
    """
    marked = _labelled(docs, labels, labelled_rows)
    counted = marked.select("body", "part").mapInArrow(_counts, "bucket long, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in sums:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    p = (raw + 1) / (raw.sum() + BUCKETS)
    prior = PRIOR * BUCKETS
    log_ratio = np.log((target + prior * p) / ((target.sum() + prior) * p))
    model = QualityModel(log_ratio, None)
    good = weighted(marked.where("part = 'good'").select("part", "body"), F.col("body"), model, leave=("body",)).select("log_weight").collect()
    if not target.any() or not good:
        return model
    return QualityModel(log_ratio, float(np.quantile([r["log_weight"] for r in good], 1 - recall, method="lower")))


def gumbel(key: str = "doc_id", seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the key alone."""
    return -F.log(-F.log(uniform(key, seed=seed + 1)))


@dataclass(frozen=True)
class Resampling:
    model: QualityModel
    scored: DataFrame
    # The k-th largest noisy weight; None keeps all rows.
    cut: float | None


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> Resampling:
    """Weigh all documents and find the k-th largest of log-weight plus noise.

    ``k`` defaults to the number of documents whose weight the model does not reject. The k-th largest is
    found on the keys alone, by range partitions; rows that tie with it stay.
    """
    model = fit_quality(docs, labels, **options)
    weights = weighted(docs.select("doc_id", "text"), text_bytes(), model, leave=("text",))
    scored = materialize(
        weights.select(F.col("_given.doc_id").alias("doc_id"), "log_weight", (F.col("log_weight") + gumbel("_given.doc_id")).alias("noisy")),
        "weights",
    )
    if k is None:
        k = scored.count() if model.least_weight is None else scored.where(F.col("log_weight") >= model.least_weight).count()
    n = scored.count()
    if k >= n:
        return Resampling(model, scored, None)
    if k <= 0:
        return Resampling(model, scored, float("inf"))
    ranked = global_row_index(scored.select("noisy"), "noisy")
    return Resampling(model, scored, ranked.where(F.col("row_idx") == n - k).first()["noisy"])


def sampled(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """The documents drawn: doc_id, log_weight, noisy_weight, kept (true).

    A null or empty text has weight 0 (neither model prefers it). Noise depends on doc_id and seed, so
    repeated rows go or stay together. Other columns are ignored; empty tables give no rows.
    """
    drawn = resample(docs, labels, k, **options)
    kept = drawn.scored if drawn.cut is None else drawn.scored.where(F.col("noisy") >= drawn.cut)
    return kept.select("doc_id", "log_weight", F.col("noisy").alias("noisy_weight"), F.lit(True).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """``docs`` without the documents that are not drawn; all columns pass through.

    The weights are computed once more beside the texts: cheaper than moving texts to a join.
    """
    drawn = resample(docs, labels, k, **options)
    if drawn.cut is None:
        return docs
    noisy = F.col("log_weight") + gumbel("_given.doc_id")
    kept = weighted(docs, text_bytes(), drawn.model).where(noisy >= drawn.cut)
    return kept.select(*[F.col("_given").getField(c).alias(c) for c in docs.columns])
