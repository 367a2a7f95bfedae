"""Global row numbers by an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

# Monotonic ids carry the partition in the bits above this one and the row number below.
_ROW_BITS = 33


def global_row_index(
    df: DataFrame, order_by: str | Sequence[str], name: str = "row_idx", partitions: int | None = None
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in ascending order of the columns ``order_by``.

    Together the columns must identify a row. The rows are range-partitioned, sorted inside their
    partition and written to the shared scratch folder; the number is the size of the partitions
    before plus the place inside the partition. No task sees more than one range, and only the table
    of partition sizes is broadcast, which has one row per partition. Select the columns you need
    first: everything in ``df`` is shuffled once.
    """
    columns = [order_by] if isinstance(order_by, str) else list(order_by)
    ranged = (
        df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    )
    placed = materialize(
        ranged.sortWithinPartitions(*columns).withColumn("_seq", F.monotonically_increasing_id()),
        "row-index",
    )
    part = F.shiftrightunsigned("_seq", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_seq").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select((F.col("_offset") + place).alias(name), *df.columns)
    )
