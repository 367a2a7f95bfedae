"""Sparse training rows as bytes, and sums over all of them for many labels in one pass.

A row is three binaries: positions, values and 0/1 truths, so a pass moves bytes between the JVM and Python instead of
numbers. The rows lie on disk and neither the JVM nor a Python worker ever holds more of them than a batch, of which a
worker takes VALUES values at a time. A task sums its rows in blocks of features; blocks are merged by a shuffle, and
features x labels numbers reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Features summed in one shuffled row.
BLOCK = 8_192
# Values a worker takes at a time; a single row may have more.
VALUES = 1 << 17
_PACKED = "at binary, values binary, truth binary"
_SUMS = "block int, sums binary"
# Spark then deletes the shuffle files of a query at its end; else those of all passes pile up.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Rows:
    """Sparse rows: positions and values one after the other, and how many each row has."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        self.n = len(sizes)
        self.at = at.astype(np.intp, copy=False)
        self.values = values
        self.row = np.repeat(np.arange(self.n), sizes)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Rows by labels; label by label, so no more than the terms of one are held."""
        out = np.zeros((self.n, weights.shape[1]))
        if len(self.row):
            starts = np.flatnonzero(np.diff(self.row, prepend=-1))
            filled = self.row[starts]
            terms = np.empty(len(self.at))
            for label, column in enumerate(np.ascontiguousarray(weights.T)):
                # Every position is in range; clipping only spares a buffered check.
                np.take(column, self.at, out=terms, mode="clip")
                terms *= self.values
                out[filled, label] = np.add.reduceat(terms, starts)
        return out

    def gradient(self, errors: np.ndarray, into: np.ndarray) -> None:
        """Add to ``into``, features by labels: label by label, in one pass over the values and without sorting them."""
        terms = np.empty(len(self.at))
        for label, column in enumerate(np.ascontiguousarray(errors.T)):
            np.take(column, self.row, out=terms, mode="clip")
            terms *= self.values
            into[:, label] += np.bincount(self.at, terms, len(into))


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Rows from and to, and their values from and to, of at most VALUES values or one row."""
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + VALUES, "right")) - 1)
        yield first, last, int(ends[first]), int(ends[last])
        first = last


def _as_binary(lists: pa.ListArray, dtype: type) -> pa.Array:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    offsets = np.concatenate(([0], np.cumsum(sizes) * numbers.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(numbers)])


def _as_numbers(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows end to end, and how many each row has."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    item = np.dtype(dtype).itemsize
    if ends[-1] == ends[0]:
        return np.zeros(0, dtype), np.diff(ends)
    return np.frombuffer(data, dtype, (ends[-1] - ends[0]) // item, ends[0]), np.diff(ends) // item


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.column("truth").null_count or batch.column("truth").flatten().null_count:
            raise ValueError("a training row has no labels: null")
        sizes = batch.column("values").value_lengths().to_numpy(zero_copy_only=False)
        for first, last, _, _ in _pieces(sizes):
            part = batch.slice(first, last - first)
            columns = [_as_binary(part.column(c), t) for c, t in (("indices", np.int32), ("values", np.float64), ("truth", np.int8))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "values", "truth"])


def pack(prepared: DataFrame) -> DataFrame:
    """``prepared (features, truth)``, sparse vectors and 0/1 arrays, packed and kept on disk; the caller lets it go."""
    vector = F.unwrap_udt("features")
    rows = prepared.select(vector["indices"].alias("indices"), vector["values"].alias("values"), "truth")
    return rows.mapInArrow(_packed, _PACKED).persist(StorageLevel.DISK_ONLY)


def _unpacked(batches: Iterator[pa.RecordBatch], n_labels: int) -> Iterator[tuple[Rows, np.ndarray]]:
    """Rows and truths, VALUES values at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, sizes = _as_numbers(batch.column("at"), np.int32)
        values, _ = _as_numbers(batch.column("values"), np.float64)
        truth = _as_numbers(batch.column("truth"), np.int8)[0].reshape(-1, n_labels)
        for first, last, begin, end in _pieces(sizes):
            yield Rows(sizes[first:last], at[begin:end], values[begin:end]), truth[first:last]


def _blocks(ends: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """``sums``, features by whatever is summed, in blocks of features; ``ends`` are block -1."""
    blocks = [(-1, ends.tobytes())]
    for b in range(0, len(sums), BLOCK):
        part = sums[b : b + BLOCK]
        if part.any():
            blocks.append((b, part.tobytes()))
    names, sums_ = zip(*blocks)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(sums_, pa.binary())], names=["block", "sums"])


def _merged(merge: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Blocks of a partition merged one after the other as they come."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums")):
                part = np.frombuffer(sums.as_buffer())
                if block not in totals:
                    totals[block] = part.copy()
                else:
                    totals[block] = totals[block] + part if block < 0 else merge(totals[block], part)
        columns = [pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "sums"])

    return of


def _sums(packed: DataFrame, partial: Callable, merge: Callable, n_features: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Block -1, and the others as features by ``width`` with a last row to fill in."""
    conf = packed.sparkSession.conf
    blocks, before = -(-n_features // BLOCK) + 1, conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        # One partial sum per core, however many partitions there are.
        parts = packed.coalesce(packed.sparkSession.sparkContext.defaultParallelism).mapInArrow(partial, _SUMS)
        found = parts.repartition(blocks, "block").mapInArrow(_merged(merge), _SUMS).collect()
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)
    out, ends = np.zeros((n_features + 1, width)), np.zeros(0)
    while found:
        row = found.pop()
        sums = np.frombuffer(row["sums"])
        if row["block"] < 0:
            ends = sums
        else:
            sums = sums.reshape(-1, width)
            out[row["block"] : row["block"] + len(sums)] = sums
    return ends, out


@dataclass(frozen=True)
class Moments:
    """Number of rows, rows per label that carry it, and mean and unbiased variance per feature."""

    n: int
    supports: np.ndarray
    mean: np.ndarray
    variance: np.ndarray


def _partial_moments(n_features: int, n_labels: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, found = np.zeros(1 + n_labels), np.zeros((n_features, 3))
        seen, first = np.zeros(n_features, bool), np.zeros(n_features)
        for rows, truth in _unpacked(batches, n_labels):
            ends += np.concatenate(([rows.n], truth.sum(axis=0)))
            # Sums run about a value that occurs, so a feature that is the same throughout deviates by nothing.
            new = ~seen[rows.at]
            first[rows.at[new]] = rows.values[new]
            seen[rows.at] = True
            moved = rows.values - first[rows.at]
            for k, terms in enumerate((None, moved, moved * moved)):
                found[:, k] += np.bincount(rows.at, terms, n_features)
        count = np.maximum(found[:, 0], 1)
        found[:, 2] = np.maximum(found[:, 2] - found[:, 1] ** 2 / count, 0)
        found[:, 1] = first + found[:, 1] / count
        yield _blocks(ends, found)

    return of


def _merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and squared deviations of two lots as those of both."""
    a, b = a.reshape(-1, 3), b.reshape(-1, 3)
    count, apart = a[:, 0] + b[:, 0], b[:, 1] - a[:, 1]
    share = b[:, 0] / np.maximum(count, 1)
    return np.stack([count, a[:, 1] + apart * share, a[:, 2] + b[:, 2] + apart**2 * a[:, 0] * share], axis=1).ravel()


def moments(packed: DataFrame, n_features: int, n_labels: int) -> Moments:
    ends, found = _sums(packed, _partial_moments(n_features, n_labels), _merged_moments, n_features, 3)
    n = int(ends[0])
    count, mean, squares = found[:-1].T
    # The values that a row does not name are zeros.
    squares = squares + mean**2 * count * (n - count) / max(n, 1)
    return Moments(n, ends[1:], mean * count / max(n, 1), squares / max(n - 1, 1))


def _partial_gradients(shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercepts, labels, n_labels = shared.value
        gradient, ends = np.zeros(weights.shape, order="F"), np.zeros((2, len(labels)))
        for rows, truth in _unpacked(batches, n_labels):
            truth = truth[:, labels].astype(float)
            logits = rows.scores(weights) + intercepts
            errors = 1 / (1 + np.exp(-np.clip(logits, -500, 500))) - truth
            ends[0] += (np.logaddexp(0, logits) - truth * logits).sum(axis=0)
            ends[1] += errors.sum(axis=0)
            rows.gradient(errors, gradient)
        yield _blocks(ends, gradient)

    return of


def gradients(packed: DataFrame, known: Moments, weights: np.ndarray, intercepts: np.ndarray, labels: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Summed logistic loss of ``labels``, and its summed gradient with the intercepts in the last row.

    ``weights`` are features by ``labels``, the positions of some of the packed labels.
    """
    # Label after label in memory, as the rows take them.
    given = np.asfortranarray(weights), intercepts, np.array(labels), len(known.supports)
    shared = packed.sparkSession.sparkContext.broadcast(given)
    ends, found = _sums(packed, _partial_gradients(shared), np.add, len(weights), len(labels))
    shared.destroy()
    loss, found[-1] = ends.reshape(2, -1)
    return loss, found
