"""Reader of JSON arrays in byte ranges: one file of any size is read by as many tasks as it has file splits.

The text reader cuts a file at every ``{`` and divides it into ranges by itself, on any file system that Spark
reaches. Whether such a cut starts a record depends on everything before it: an odd number of quotes means that
it lies inside a string, and the braces closed so far say how deep it lies. A first pass sums up each range for
both possible states at its start; the ranges compose like a prefix sum, over one row per range. A second pass
then knows where each range starts and puts the records together. Only records that cross a range are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import materialize
from docloom.sources.position import MAX_BROADCAST_SPLITS, file_order

_FAR = np.iinfo(np.int64).max
# Characters of records that one batch may hold before it is handed on.
_BATCH_CHARS = 1 << 24


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between two opening braces, with its quotes and the closing braces outside strings.

    ``closes0`` counts those outside if the piece starts outside a string, ``closes1`` if inside.
    """
    text = spark.read.text(path, lineSep="{")
    # Without escaped characters every quote left begins or ends a string. Valid JSON has no backslash before a brace.
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)

    def closing(odd: int) -> Column:
        kept = F.array_join(F.filter("_parts", lambda _, i: i % 2 == odd), "")
        return F.length(kept) - F.length(F.replace(kept, F.lit("}"), F.lit("")))

    placed = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), parts.alias("_parts"))
    return placed.select(
        "_file", "_block", "value", (F.size("_parts") - 1).cast("long").alias("quotes"), closing(0).cast("long").alias("closes0"), closing(1).cast("long").alias("closes1")
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """Stretches of a batch that belong to one range: its name, from, to."""
    files, blocks = batch.column("_file").to_pylist(), batch.column("_block").to_pylist()
    start = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or files[i] != files[start] or blocks[i] != blocks[start]:
            yield (files[start], blocks[start]), start, i
            start = i


def _walk(quotes: np.ndarray, closes0: np.ndarray, closes1: np.ndarray, first: bool, state: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of each piece whether its brace lies in a string and how deep, then both after the last piece.

    The first piece of a file has no brace before it.
    """
    inside = (state + np.cumsum(quotes) - quotes) % 2
    opened = 1 - inside
    if first and len(opened):
        opened[0] = 0
    change = opened - np.where(inside == 0, closes0, closes1)
    after = depth + np.cumsum(change)
    return inside, after - change, int((state + quotes.sum()) % 2), int(after[-1]) if len(after) else depth


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: quotes, and for both states at its start the change of depth and the least depth of a
    brace outside strings, with the number of braces that lie there."""
    name, quotes, sides = None, 0, []
    done: list[tuple] = []

    def close() -> None:
        if name is not None:
            done.append((*name, quotes, *[v for _, depth, least, n in sides for v in (depth, least, n)]))

    for batch in batches:
        numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("quotes", "closes0", "closes1")]
        for run, a, b in _runs(batch):
            first = run != name and run[1] == 0
            if run != name:
                close()
                name, quotes, sides = run, 0, [(0, 0, _FAR, 0), (1, 0, _FAR, 0)]
            part = [n[a:b] for n in numbers]
            quotes += int(part[0].sum())
            for i, (state, depth, least, n) in enumerate(sides):
                inside, before, state, depth = _walk(*part, first, state, depth)
                outside = before[(inside == 0) & (np.arange(b - a) >= int(first))]
                if len(outside):
                    low = int(outside.min())
                    n = (n if least <= low else 0) + (int((outside == low).sum()) if low <= least else 0)
                    least = min(least, low)
                sides[i] = (state, depth, least, n)
    close()
    names = ["_file", "_block", "quotes", *[f"{c}{s}" for s in (0, 1) for c in ("change", "least", "starts")]]
    types = [pa.string(), *[pa.int64()] * (len(names) - 1)]
    columns = zip(*done) if done else [[]] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_RANGE_SCHEMA = "_file string, _block long, quotes long, change0 long, least0 long, starts0 long, change1 long, least1 long, starts1 long"


def _ranges(pieces: DataFrame) -> DataFrame:
    """``(_of_file, _of_block, inside, depth, first, last)`` of every range: its state and row at its start."""
    sums = materialize(pieces.drop("value").mapInArrow(_summed, _RANGE_SCHEMA), "json-ranges")
    in_file = Window.partitionBy("_file").orderBy("_block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    stated = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    chosen = [F.when(F.col("inside") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(c) for c in ("change", "least", "starts")]
    deep = stated.select("_file", "_block", "inside", *chosen).withColumns(
        {"depth": F.coalesce(F.sum("change").over(earlier), F.lit(0)), "last": F.lead("_block").over(in_file).isNull()}
    )
    # Braces at the least depth of a range start records if that depth is the array's own.
    found = deep.withColumn("records", F.when(F.col("least") == -F.col("depth"), F.col("starts")).otherwise(0))
    # One row per range, so the single-partition window is small.
    before = Window.orderBy(*file_order(), "_block").rowsBetween(Window.unboundedPreceding, -1)
    return found.select(
        F.col("_file").alias("_of_file"), F.col("_block").alias("_of_block"), "inside", "depth", "last", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first")
    )


def _broken(file: str, why: str) -> ValueError:
    return ValueError(f"broken JSON array in {file}: {why}")


class _Range:
    """The records of one range, piece by piece."""

    def __init__(self, file: str, block: int, inside: int, depth: int, row: int, last: bool) -> None:
        self.file, self.block, self.inside, self.depth, self.row, self.last = file, block, inside, depth, row, last
        self.crossed = bool(inside or depth)
        self.started = block > 0
        self.closed = False
        self.parts: list[str] = []
        self.out: list[tuple[int, int, str, bool]] = []
        self.held = 0

    def _emit(self, text: str, whole: bool) -> None:
        # The record under way has the number before the next one to start.
        self.out.append((self.row - 1, self.block, text, whole))
        self.held += len(text)

    def take(self, texts: list[str], quotes: np.ndarray, closes0: np.ndarray, closes1: np.ndarray) -> None:
        first = not self.started
        inside, before, state, depth = _walk(quotes, closes0, closes1, first, self.inside, self.depth)
        after = np.append(before[1:], depth)
        for i, text in enumerate(texts):
            if self.closed:
                raise _broken(self.file, "text after its end")
            if not self.started:
                self.started = True
                head = text.strip()
                if head[:1] == "[" and head[-1:] == "]" and not head[1:-1].strip():
                    self.closed = True
                elif head != "[":
                    raise _broken(self.file, "it does not begin with records")
                continue
            if inside[i] == 0 and before[i] == 0:
                self.row += 1
                self.crossed = False
            if after[i] < 0:
                raise _broken(self.file, "a brace too many")
            if after[i]:
                self.parts.append(text)
                continue
            end = text.rfind("}") + 1
            tail = text[end:].strip()
            if tail not in (",", "]"):
                raise _broken(self.file, "no comma after a record")
            self.closed = tail == "]"
            self._emit("{" + "{".join([*self.parts, text[:end]]), not self.crossed)
            self.parts = []
        self.inside, self.depth = state, depth

    def end(self) -> None:
        if self.parts:
            self._emit("{" + "{".join(self.parts), False)
            self.parts = []
        if self.last and not self.closed:
            raise _broken(self.file, "it ends within a record")
        if self.closed and not self.last:
            raise _broken(self.file, "text after its end")

    def drain(self) -> pa.RecordBatch:
        rows, self.out, self.held = self.out, [], 0
        columns = zip(*rows) if rows else [[]] * 4
        types = [pa.int64(), pa.int64(), pa.large_string(), pa.bool_()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays([arrays[0], arrays[1], arrays[2].cast(pa.string()), arrays[3]], names=["row_idx", "block", "record", "whole"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: _Range | None = None
    for batch in batches:
        numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("quotes", "closes0", "closes1")]
        for (file, block), a, b in _runs(batch):
            if current is None or (current.file, current.block) != (file, block):
                if current is not None:
                    current.end()
                    yield current.drain()
                found = [batch.column(c)[a].as_py() for c in ("inside", "depth", "first", "last")]
                if found[0] is None:
                    raise _broken(file, "it changed, or its ranges did, while it was read")
                current = _Range(file, block, *found)
            current.take(batch.column("value")[a:b].to_pylist(), *[n[a:b] for n in numbers])
            if current.held > _BATCH_CHARS:
                yield current.drain()
    if current is not None:
        current.end()
        yield current.drain()


def scan_json_array(spark: SparkSession, path: str, schema: T.StructType, name: str = "row_idx") -> DataFrame:
    """The records of JSON arrays of objects, one array per file, with their position over the files in path order.

    Objects may nest, and strings may hold braces, quotes and anything else. Files are UTF-8. A file that is cut,
    closes too many braces, has text after its array or something else than objects in it is an error, never a
    null record; so is a record that is no JSON. Both passes need the same ranges: a setting that changes them in
    between is an error, too. A record crosses ranges as it likes; a range without a record gives none.
    """
    pieces = _pieces(spark, path)
    ranges = materialize(_ranges(pieces), "json-starts")
    if ranges.count() <= MAX_BROADCAST_SPLITS:
        ranges = F.broadcast(ranges)
    placed = pieces.join(ranges, (F.col("_file") == F.col("_of_file")) & (F.col("_block") == F.col("_of_block")), "left")
    placed = placed.select("_file", "_block", "value", "quotes", "closes0", "closes1", "inside", "depth", "first", "last")
    read = placed.mapInArrow(_records, "row_idx long, block long, record string, whole boolean")
    whole = read.where("whole").select("row_idx", "record")
    parts = read.where("not whole").groupBy("row_idx").agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"))
    crossing = parts.select("row_idx", F.array_join(F.col("parts.record"), "").alias("record"))
    parsed = F.from_json("record", schema, {"mode": "FAILFAST"}).alias("_record")
    records = whole.unionByName(crossing).select(F.col("row_idx").alias(name), parsed)
    return records.select(name, *[F.col("_record").getField(f.name).alias(f.name) for f in schema.fields])
