"""The most frequent items of array columns without shuffling every distinct item.

Each task keeps a summary of a bounded number of counters: when there are more, the count of the first one too
many is taken from all, so an item's count is too low by what was taken at most. The summaries are added up, and
so is what all tasks took. Items that may belong to the top by that bound are then counted exactly. Where the
bound does not exclude the items outside all summaries, more counters are kept, and beyond ``MOST_COUNTERS`` every
item is counted. The result is exact in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize

COUNTERS = 1 << 18
MOST_COUNTERS = 1 << 21


class Summary:
    """Counts of the most frequent items, each too low by ``taken`` at most."""

    def __init__(self, counters: int) -> None:
        self.counters, self.taken = counters, 0
        self.counts: dict[str, int] = {}

    def add(self, items: list[str], counts: list[int]) -> None:
        for item, n in zip(items, counts):
            self.counts[item] = self.counts.get(item, 0) + n
        # Twice the number is let grow, so that cutting stays rare.
        if len(self.counts) > 2 * self.counters:
            self.cut()

    def cut(self) -> None:
        if len(self.counts) <= self.counters:
            return
        values = np.fromiter(self.counts.values(), np.int64, len(self.counts))
        least = int(np.partition(values, len(values) - self.counters - 1)[len(values) - self.counters - 1])
        self.counts = {item: n - least for item, n in self.counts.items() if n > least}
        self.taken += least


def _summaries(counters: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(counters)
        for batch in batches:
            found = pc.value_counts(batch.column("items").flatten().drop_null())
            summary.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        summary.cut()
        items, counts = list(summary.counts), list(summary.counts.values())
        for i in range(0, len(items), 1 << 16):
            part = pa.array(items[i : i + (1 << 16)], pa.string())
            yield pa.RecordBatch.from_arrays([part, pa.array(counts[i : i + (1 << 16)], pa.int64())], names=["item", "n"])
        # The row without an item says what was taken.
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([summary.taken], pa.int64())], names=["item", "n"])

    return of


def top_items(rows: DataFrame, items: str, k: int, counters: int = COUNTERS, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """``(item, n_uses)`` of the ``k`` most frequent elements of the array column ``items``, equal counts by item.

    Null arrays and null elements are passed over. Shuffled rows are ``counters`` a task at most.
    """
    given = rows.select(F.col(items).alias("items"))
    exploded = given.select(F.explode("items").alias("item")).where("item is not null")
    ranked = [F.desc("n_uses"), F.asc("item")]
    while counters <= most_counters:
        parts = given.where("items is not null").mapInArrow(_summaries(counters), "item string, n long")
        summed = materialize(parts.groupBy("item").agg(F.sum("n").alias("n_uses")), "frequent-items")
        missing = summed.where("item is null").first()
        taken = missing["n_uses"] if missing else 0
        named = summed.where("item is not null")
        top = named.orderBy(*ranked).limit(k)
        if not taken:
            return top
        least = [row["n_uses"] for row in top.collect()]
        # An item outside every summary has been used as often as was taken, at most.
        if len(least) == k and taken < least[-1]:
            able = named.where(F.col("n_uses") + F.lit(taken) >= F.lit(least[-1])).select("item")
            if able.count() <= counters:
                able = F.broadcast(able)
            exploded = exploded.join(able, "item", "left_semi")
            break
        counters *= 4
    return exploded.groupBy("item").agg(F.count(F.lit(1)).alias("n_uses")).orderBy(*ranked).limit(k)
