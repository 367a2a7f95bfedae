"""Row numbers by position in the scanned files, without a shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

# File splits up to which their offsets are broadcast, some 40 bytes each; beyond, rows meet them in a join.
MAX_BROADCAST_SPLITS = 8_000_000
# Monotonic ids carry the partition in the bits above this one and the row number below.
_ROW_BITS = 33


def file_order(file: str = "_file") -> list[Column]:
    """Path order: by folder, then numbered part files by their number, then by name."""
    folder = F.regexp_extract(file, r"^(.*/)?[^/]*$", 1)
    number = F.regexp_extract(file, r"/part-(\d{1,18})[^/]*$", 1).try_cast("long")
    return [folder, number, F.col(file)]


def with_file_position(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Add the 0-based position of each row, counted over the files in path order.

    Numbered part files count in the order of their numbers. ``df`` must come straight from a file scan. A
    first pass counts the rows of every file split, a second adds the offset of the split to the position
    inside it; only the table of splits is shuffled. Both passes must pack the splits into the same
    partitions: a setting or a cluster that changed in between is an error, never a wrong number.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    splits = materialize(
        placed.groupBy("_file", "_block").agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min("_seq").alias("_first"),
            # Reading a column makes this pass parse the rows as the second one does: a scan of no
            # columns would also count blank lines.
            F.count(df.columns[0]).alias("_parsed"),
        ),
        "file-splits",
    )
    # One row per file split, so the single-partition window is small.
    in_order = Window.orderBy(*file_order(), "_block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    if splits.count() <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    joined = placed.join(offsets, ["_file", "_block"], "left")
    # A split that the first pass did not see means that the files changed in between; one in another
    # partition, that the splits were packed anew, so that the position inside it is not known.
    same = F.shiftrightunsigned("_seq", _ROW_BITS) == F.shiftrightunsigned("_first", _ROW_BITS)
    changed = F.raise_error(F.lit("the files or their packing changed while they were being numbered"))
    position = F.when(same, F.col("_offset") + F.col("_seq") - F.col("_first")).otherwise(changed.cast("long"))
    return joined.select(position.alias(name), *df.columns)
