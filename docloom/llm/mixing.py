"""Mixing sources to target weights by systematic sampling.

Targets are a water level: every source gets its weight times the level, at most a multiple of its size, and
the level is what makes them add up. Each document then expects target / source size copies. Expected copies
are summed up along a source, one random offset is added, and a document is emitted once per integer boundary
that its stretch crosses. Along a source documents go from the longest to the shortest, so that the words taken
differ from the target by the longest document of the source at most.

The running sums come from one range shuffle: a partition sums its own stretch, and the sums of the partitions
before are added afterwards. A source that holds most rows spreads over partitions like any other. Copies count
in whole numbers of 2**-30, so the result does not depend on the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.row_index import global_row_index
from docloom.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
SEED = 11
# Bits of a copy's fraction; four billion documents of a source fit a long.
FRACTION_BITS = 30
# Rows of a small table that is broadcast; beyond it the tables are joined by shuffles.
BROADCAST_ROWS = 100_000
_SALTS = 32
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text") -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(_WORD)), F.lit(0)).cast("long")


def mixing_targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``(source, source_size, target)`` of ``rows (source, size)``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A target
    above ``limit`` times its source's size stops there and the excess goes to the others by weight, until none
    is above. Only two sums per round reach the driver: the level rises like Newton's steps on a line of
    pieces, so rounds are few.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_absent", F.col("source").isNull())
    ranked = global_row_index(sums, ["_absent", "source"], "_rank")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", turn.alias("_weight")), "source-sizes")
    cap = F.col("source_size") * F.lit(limit)
    total = table.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    if total["size"] is None:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    level, stopped = share * total["size"] / total["weight"], 0
    while True:
        above = F.col("_weight") * F.lit(level) > cap
        found = table.agg(
            F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("given"),
            F.sum(F.when(~above, F.col("_weight"))).alias("open"),
        ).first()
        if found["n"] == stopped or not found["open"]:
            break
        level, stopped = (share * total["size"] - found["given"]) / found["open"], found["n"]
    return table.select("source", "source_size", F.least(cap, F.col("_weight") * F.lit(level)).alias("target"))


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with source_size and target; a hot source is salted where the targets are too many to broadcast."""
    named = targets.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if named.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(named), same).drop("_source")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("size", "_key"), F.lit(_SALTS)))
    named = named.withColumn("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    return salted.join(named, same & (F.col("_salt") == F.col("_of"))).drop("_source", "_salt", "_of")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the units of its source that came before it in this partition."""
    last, carried = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        units = batch.column("_units").to_numpy(zero_copy_only=False)
        sources = batch.column("source").to_pylist()
        before = np.cumsum(units) - units
        starts = [i for i in range(len(sources)) if i == 0 or sources[i] != sources[i - 1]]
        base = before[starts].copy()
        if last is not None and sources[0] == last[0]:
            base[0] -= carried
        before = before - np.repeat(base, np.diff([*starts, len(sources)]))
        last, carried = (sources[-1],), int(before[-1] + units[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "_before"])


def systematic_copies(rows: DataFrame, order: Sequence[str], seed: int = SEED) -> DataFrame:
    """``rows`` with ``copies``: how often systematic sampling emits each row of its source.

    ``rows`` holds source and ``expected``, the expected copies of a row, and is taken in the order of the
    columns ``order`` within a source. The offset depends on the seed and the source alone.
    """
    units = F.floor(F.col("expected") * F.lit(float(1 << FRACTION_BITS)) + F.lit(0.5)).cast("long")
    narrow = rows.withColumn("_units", units)
    ranged = narrow.repartitionByRange("source", *order).sortWithinPartitions("source", *order)
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    schema = ranged.withColumn("_before", F.lit(0).cast("long")).schema
    placed = materialize(ranged.mapInArrow(_summed, schema), "running-copies")
    # A source has one row per partition at most.
    sums = placed.groupBy("source", "_part").agg(F.sum("_units").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("_source"), F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    offsets = materialize(offsets, "copy-offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_of")))
    drawn = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8)
    start = F.shiftright(F.conv(drawn, 16, 10).cast("long"), 32 - FRACTION_BITS) + F.col("_offset") + F.col("_before")
    copies = F.shiftright(start + F.col("_units"), FRACTION_BITS) - F.shiftright(start, FRACTION_BITS)
    return joined.withColumn("copies", copies).select(*rows.columns, "copies")


def mix(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = SEED) -> DataFrame:
    """``rows`` with size, source_size, target (of the source, in words) and copies, the times a row is taken.

    ``rows`` are documents: doc_id, text and source, or size instead of text where words are counted already.
    All other columns pass through; those named like an added one are replaced. A null text has size 0, a null
    source is a source of its own, after all others. Documents of size 0 are counted like others and bring no
    words. Of equal sizes the smaller doc_id, null first, then the smaller hash of the text comes first;
    repeated rows follow each other. Long texts count whole; an empty table gives no rows. Reruns and other
    partitions give the same copies.
    """
    key = F.xxhash64("doc_id", *(["text"] if "text" in rows.columns else []))
    size = word_count() if "text" in rows.columns else F.col("size").cast("long")
    given = rows.withColumns({"size": size, "_key": key, "source": F.col("source").cast("string")})
    given = given.drop("source_size", "target", "copies", "expected")
    sizes = given.select("source", "size")
    targets = mixing_targets(sizes, weights, share, limit)
    placed = _with_targets(given, materialize(targets, "mixing-targets"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = placed.withColumns({"expected": expected, "_shorter": -F.col("size")})
    return systematic_copies(placed, ["_shorter", "doc_id", "_key"], seed).drop("_key", "_shorter", "expected")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as ``mix`` takes it."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*docs.columns)
