"""Filter interaction audit: what every order of a set of filters removes, and what its filters share.

Documents shrink to a bit mask of the filters they fail, and masks to counts per part: at most 2**k rows of a
part, whatever its size. On those the orders are replayed as a min-plus product: the mask matrix holds 0 where
a mask fails a filter and a step beyond the last where it does not, the position matrix is the inverse of each
permutation, and the least sum over the filters is the step at which an order removes a mask. Counts are then
scattered, weighted by documents, to (order, step).

Only digests, ids and masks are shuffled, texts never. The first document of each text is found by an
aggregation with a map-side part, and documents meet it on digest *and* id, so that copies of one text, however
many, spread over all tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import text_bytes
from docloom.session import materialize

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
# Bytes that continue a code point.
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = re.compile(rb"[#$%&*|]")
# What a part's counts become.
AUDIT_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)


def text_fails(text: bytes) -> int:
    """Bit mask of the text filters A to D that a whole text fails."""
    words = text.split()
    n, chars = len(words), len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (
        n < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * n,
        100 * capitals > MAX_CAPITALS_PERCENT * chars,
        _MARKS.search(text) is not None,
    )
    return sum(bit << i for i, bit in enumerate(fails))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = batch.column("body").to_pylist()
        digests = b"".join(hashlib.blake2b(b, digest_size=16).digest() for b in bodies)
        halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
        fails = pa.array([text_fails(b) for b in bodies], pa.int32())
        columns = [batch.column("doc_id"), batch.column("part"), pa.array(halves[:, 0]), pa.array(halves[:, 1]), fails]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "h1", "h2", "fails"])


def fail_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, fails, n, n_good, n_toxic)``: documents per part and mask of failed filters A to E.

    E, the fifth bit, marks texts that equal the text of a smaller doc_id anywhere in the table.
    """
    given = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_bytes().alias("body"))
    zero = F.lit(0).cast("long")
    schema = given.select("doc_id", "part", zero.alias("h1"), zero.alias("h2"), F.lit(0).alias("fails")).schema
    # Rows that repeat all of this count once, with their number: they meet no key of a join many times.
    rows = given.mapInArrow(_marked, schema).groupBy(*schema.names).agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "filter-marks")
    known = rows.where("doc_id is not null")
    firsts = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = known.join(firsts, ["h1", "h2", "doc_id"], "left")
    facts = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    told = told.join(facts, "doc_id", "left")
    repeated = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    columns = ["part", "n", "fails", "good", "toxic"]
    told = told.withColumn("fails", F.col("fails").bitwiseOR(repeated)).select(*columns)
    nothing = F.lit(None).cast("int")
    unnamed = rows.where("doc_id is null").withColumns({"good": nothing, "toxic": nothing}).select(*columns)
    return (
        told.unionByName(unnamed)
        .groupBy("part", "fails")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.col("n") * F.col("good")), zero).alias("n_good"),
            F.coalesce(F.sum(F.col("n") * F.col("toxic")), zero).alias("n_toxic"),
        )
    )


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Step (from 0) at which each order removes each mask, masks by orders; the number of filters: never.

    ``orders`` holds a permutation of the filters per row. The min-plus product of the mask matrix, 0 or
    never, and of the inverse permutations, which say at which step a filter comes.
    """
    k = orders.shape[1]
    positions = np.argsort(orders, axis=1)
    cost = np.where(masks[:, None] >> np.arange(k) & 1, 0, k)
    return np.minimum((cost[:, None, :] + positions[None, :, :]).min(axis=2), k)


def replay(masks: np.ndarray, weights: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Weight removed, orders by steps, and in the last column what stays."""
    steps = removal_steps(masks, orders)
    removed = np.zeros((len(orders), orders.shape[1] + 1), np.int64)
    np.add.at(removed, (np.broadcast_to(np.arange(len(orders)), steps.shape), steps), weights[:, None])
    return removed


def _audited(filters: str):
    orders = np.array(list(permutations(range(len(filters)))))
    names = ["".join(filters[f] for f in order) for order in orders]

    def of(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        masks, n = counts["fails"].to_numpy(), counts["n"].to_numpy()
        removed, good, toxic = (replay(masks, counts[c].to_numpy(), orders) for c in ("n", "n_good", "n_toxic"))
        k = len(filters)
        failing = masks[:, None] >> np.arange(k) & 1
        all_fails, alone = (failing * n[:, None]).sum(axis=0), (failing * (n * (masks.astype(np.int64) & (masks - 1) == 0))[:, None]).sum(axis=0)
        shapley = np.zeros(k, np.int64)
        np.add.at(shapley, orders, removed[:, :k])
        cut = removed[:, :k]
        table = {
            "part": key[0],
            "filter_order": np.repeat(names, k),
            "step": np.tile(np.arange(1, k + 1), len(orders)),
            "kept": n.sum() - np.cumsum(cut, axis=1).ravel(),
            "removed": cut.ravel(),
            # Whoever fails the filter of a step leaves at that step or left before.
            "redundant": (all_fails[orders] - cut).ravel(),
            "unique_fails": alone[orders].ravel(),
            "good_lost": good[:, :k].ravel(),
            "toxic_lost": toxic[:, :k].ravel(),
            "shapley": shapley[orders].ravel(),
        }
        return pd.DataFrame(table)

    return of


def audit_masks(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Every order and step per part of ``counts (part, fails, n, n_good, n_toxic)``, zeros included.

    Bit i of ``fails`` stands for ``filters[i]``. A part's group holds one row per mask, so it is small
    whatever the corpus; the k! orders bound the useful number of filters to some seven.
    """
    return counts.groupBy("part").applyInPandas(_audited("".join(filters)), AUDIT_SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang), filter_order and step: see ``AUDIT_SCHEMA``.

    A null text is the empty text, a null lang the part of the empty string. A null doc_id has no smaller one
    and is none, so it neither fails E nor makes others fail; nor has it labels. Repeated rows count each, and
    rows of one doc_id with one text do not fail E on account of each other. Labels that repeat a doc_id count
    as good or toxic if any of them says so. Very long texts are read whole, ties cannot occur, other columns
    are ignored, an empty table gives no rows.
    """
    return audit_masks(fail_masks(docs, labels))
