"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. A later model sees the words of a document and the
probabilities of all earlier categories; it is trained on probabilities that come from models which had not
seen the document (out of fold), so that it learns how far to trust them. Fitting takes a bounded sample of
labelled documents; scoring runs over all documents without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stable_sample, text_bytes

CATEGORIES = ("abusive", "toxic", "severe")
# Labelled documents used at most, words each linear model may use, and folds.
LABELLED_ROWS = 12_000
MAX_WORDS = 4096
FOLDS = 5
MIN_DOCUMENTS = 5
# Chance, over all words, that a word without any bearing is taken.
_CHANCE = 1e-3
# Ridge penalty per weight and steps of the fit.
_RIDGE = 1.0
_STEPS = 120
# A word is abusive if toxic documents hold it so many times as often as others, and in so many documents.
_LEXICON_RATIO = 20.0
_LEXICON_SHARE = 0.05
_SEVERE_WORDS = 3
_SEED = 11

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_hashes(text: bytes) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the lower-cased words of a whole text."""
    return np.unique(np.fromiter(map(zlib.crc32, set(_WORD.findall(text.lower()))), np.uint32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Rows:
    """Sparse rows: word numbers end to end, and where each row starts."""

    words: np.ndarray
    starts: np.ndarray

    def margins(self, weights: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0.0], np.cumsum(weights[self.words])))[self.starts])

    def gradient(self, residual: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.words, np.repeat(residual, np.diff(self.starts)), minlength=n)

    def only(self, words: np.ndarray, n_words: int) -> Rows:
        """The same rows with only these words, numbered in their order."""
        number = np.full(n_words, -1)
        number[words] = np.arange(len(words))
        kept = number[self.words]
        upto = np.concatenate(([0], np.cumsum(kept >= 0)))
        return Rows(kept[kept >= 0], upto[self.starts])

    def take(self, rows: np.ndarray) -> Rows:
        parts = [self.words[self.starts[i] : self.starts[i + 1]] for i in rows]
        return _rows(parts)


def _rows(parts: list[np.ndarray]) -> Rows:
    return Rows(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64))


@dataclass
class Linear:
    """Weights of words, of earlier categories' logits, and the intercept."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return rows.margins(self.words) + earlier @ self.earlier + self.bias


def _select(rows: Rows, y: np.ndarray, n_words: int) -> np.ndarray:
    """The words that tell the classes apart most, by the chi-square of their presence.

    Only words whose chi-square would be a surprise among so many words are taken.
    """
    total = np.bincount(rows.words, minlength=n_words).astype(float)
    positive = rows.gradient(y, n_words)
    n, share = len(y), y.mean()
    expected = total * share
    chi = (positive - expected) ** 2 / np.maximum(total * share * (1 - share) * (1 - total / (n + 1)), 1e-9)
    chi[total < MIN_DOCUMENTS] = 0
    surprising = chi >= 2 * np.log(max(1, n_words) / _CHANCE)
    return np.argsort(-chi, kind="stable")[: min(MAX_WORDS, int(surprising.sum()))]


def fit_linear(rows: Rows, earlier: np.ndarray, y: np.ndarray, n_words: int) -> Linear:
    """Ridge logistic regression by accelerated gradient steps, each coordinate scaled by its curvature."""
    chosen = _select(rows, y, n_words)
    few, m = rows.only(chosen, n_words), len(chosen)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    weights = np.zeros(m + earlier.shape[1] + 1)
    weights[-1] = _logit(np.array([share]))[0]
    look, before = weights.copy(), weights.copy()
    # Words of a row that count, for a safe step width.
    longest = float(np.percentile(np.diff(few.starts), 99))
    width = max(1.0, longest) + np.abs(earlier).sum(axis=1).max(initial=0.0) + 1
    scale = np.concatenate([np.bincount(few.words, minlength=m), (earlier**2).sum(axis=0), [len(y)]])
    step = 4.0 / (width * np.maximum(scale, 1.0) + 4 * _RIDGE)
    for t in range(_STEPS):
        residual = _sigmoid(few.margins(look[:m]) + earlier @ look[m:-1] + look[-1]) - y
        slope = np.concatenate([few.gradient(residual, m), earlier.T @ residual, [residual.sum()]])
        slope[:-1] += _RIDGE * look[:-1]
        before, weights = weights, look - step * slope
        look = weights + t / (t + 3) * (weights - before)
    words = np.zeros(n_words)
    words[chosen] = weights[:m]
    return Linear(words, weights[m:-1], float(weights[-1]))


@dataclass
class ChainModel:
    """Hashes of the words in use, their weights per category, and thresholds; no words: nothing is flagged."""

    hashes: np.ndarray
    words: np.ndarray
    earlier: list[np.ndarray]
    bias: np.ndarray
    thresholds: np.ndarray
    categories: tuple[str, ...] = CATEGORIES

    def probabilities(self, text: bytes) -> np.ndarray:
        found = word_hashes(text)
        at = np.searchsorted(self.hashes, found)
        hit = at[self.hashes[np.minimum(at, len(self.hashes) - 1)] == found] if len(self.hashes) else at[:0]
        base = self.words[hit].sum(axis=0) + self.bias if len(hit) else self.bias
        p = np.zeros(len(self.categories))
        for c, weights in enumerate(self.earlier):
            p[c] = _sigmoid(base[c] + _logit(p[:c]) @ weights)
        return p


def derived_categories(rows: Rows, toxic: np.ndarray, n_words: int) -> np.ndarray:
    """Targets of the chain, from one label: uses words typical of toxic documents; toxic; toxic with several."""
    inside, total = rows.gradient(toxic, n_words), np.bincount(rows.words, minlength=n_words)
    n = max(1.0, toxic.sum())
    others = (total - inside + 0.5) / (len(toxic) - n + 1)
    typical = (inside >= _LEXICON_SHARE * n) & (inside >= MIN_DOCUMENTS) & ((inside + 0.5) / (n + 1) > _LEXICON_RATIO * others)
    uses = rows.margins(typical.astype(float))
    return np.stack([uses > 0, toxic > 0, (toxic > 0) & (uses >= _SEVERE_WORDS)], axis=1).astype(float)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which F1 of the out-of-fold predictions is largest; ties take the highest."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(1.0, y.sum()))
    last = np.concatenate((p[order][1:] != p[order][:-1], [True]))
    best = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def fit_chain(hashes: list[np.ndarray], toxic: np.ndarray, folds: np.ndarray) -> ChainModel:
    """Fit the chain on labelled documents given by their word hashes."""
    values, counts = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint32)]), return_counts=True)
    values = values[counts >= MIN_DOCUMENTS]
    k = len(CATEGORIES)
    if not len(values) or toxic.all() or not toxic.any():
        return ChainModel(values[:0], np.zeros((0, k)), [np.zeros(c) for c in range(k)], np.full(k, -40.0), np.full(k, 0.5))
    parts = []
    for h in hashes:
        at = np.searchsorted(values, h)
        parts.append(at[values[np.minimum(at, len(values) - 1)] == h])
    rows, n_words = _rows(parts), len(values)
    y = derived_categories(rows, toxic, n_words)
    earlier, models, thresholds = np.zeros((len(toxic), 0)), [], []
    for c in range(k):
        held_out = np.full(len(toxic), y[:, c].mean())
        for fold in range(FOLDS):
            train, test = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            if len(test) and len(train) and 0 < y[train, c].sum() < len(train):
                model = fit_linear(rows.take(train), earlier[train], y[train, c], n_words)
                held_out[test] = _sigmoid(model.logits(rows.take(test), earlier[test]))
        models.append(fit_linear(rows, earlier, y[:, c], n_words))
        thresholds.append(best_threshold(held_out, y[:, c]))
        earlier = np.column_stack([earlier, _logit(held_out)])
    words = np.stack([m.words for m in models], axis=1)
    used = np.flatnonzero(np.abs(words).max(axis=1) > 1e-6)
    bias = np.array([m.bias for m in models])
    return ChainModel(values[used], words[used], [m.earlier for m in models], bias, np.array(thresholds))


def fit_toxicity(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> ChainModel:
    """Fit on at most ``labelled_rows`` labelled documents, chosen by a hash of doc_id.

    Their words reach the driver as hashes. A document labelled both ways counts as toxic. Without both
    kinds of labels nothing is flagged.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = stable_sample(known, labelled_rows, "doc_id", _SEED).select(F.col("doc_id").alias("known_id"), "toxic")
    fold = F.pmod(F.xxhash64(F.lit(_SEED + 1), "doc_id"), F.lit(FOLDS)).cast("int")
    given = docs.select("doc_id", text_bytes().alias("body")).join(F.broadcast(few), F.col("doc_id") == F.col("known_id"))
    given = given.select("doc_id", "body", F.col("toxic").cast("double").alias("toxic"), fold.alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_hashes(b).tobytes() for b in batch.column("body").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "toxic", "fold")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=["doc_id", "toxic", "fold", "words"])

    schema = given.select("doc_id", "toxic", "fold", F.col("body").alias("words")).schema
    # Repeated rows of a document are one example.
    rows = given.mapInArrow(run, schema).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    hashes = [np.frombuffer(bytes(r["words"]), np.uint32) for r in rows]
    return fit_chain(hashes, np.array([r["toxic"] for r in rows]), np.array([r["fold"] for r in rows]))


def score_toxicity(docs: DataFrame, model: ChainModel) -> DataFrame:
    """Per document: doc_id, p_abusive, p_toxic, p_severe, toxic (boolean, at the threshold).

    Whole texts; null and empty texts get the probabilities of a text without known words. Repeated rows
    are each scored; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{c}" for c in model.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            p = np.array([chain.probabilities(b) for b in batch.column("body").to_pylist()]).reshape(-1, len(names))
            flag = p[:, chain.categories.index("toxic")] >= chain.thresholds[chain.categories.index("toxic")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(p[:, c]) for c in range(len(names))], pa.array(flag)],
                names=["doc_id", *names, "toxic"],
            )

    given = docs.select("doc_id", text_bytes().alias("body"))
    schema = given.select("doc_id", *[F.lit(0.0).alias(n) for n in names], F.lit(True).alias("toxic")).schema
    return given.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels, labelled_rows))
