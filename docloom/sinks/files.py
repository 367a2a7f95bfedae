"""Writers of the tab-separated pair, line corpora and metric records.

Row order in the files is the order of ``row_idx`` over the part files in name order, and part files of
the same number hold the same rows, so lines of two outputs pair up. Inside Spark join on ``row_idx``
instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.labels import join_labels
from docloom.session import discard, materialize, scratch_path
from docloom.sources.text_files import TSV_OPTIONS


ROWS_PER_FILE = 100_000


def last_position(df: DataFrame) -> int:
    """The largest ``row_idx``, 0 without rows."""
    return df.agg(F.max("row_idx")).first()[0] or 0


def _in_order(df: DataFrame, last: int | None) -> DataFrame:
    """Rows by position over the files and inside them.

    The file of a row follows from its position, so there is one shuffle without the sampling pass of a
    global sort, and no task holds more than one range of positions.
    """
    rows = (last_position(df) if last is None else last) + 1
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = max(-(-rows // ROWS_PER_FILE), min(cores, rows))
    # Whole-number arithmetic in this order stays below 2**63 for any realistic corpus.
    file = F.expr(f"cast(row_idx * {files}L div {rows}L as int)")
    return df.repartitionById(files, file).sortWithinPartitions("split", "row_idx").drop("row_idx")


def _write_tsv(df: DataFrame, path: str, compression: str | None) -> None:
    # A lone empty field must be quoted, or its line would be blank and lost on reading.
    writer = df.write.mode("overwrite").partitionBy("split").options(**dict(TSV_OPTIONS, emptyValue='""'))
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def write_inputs(df: DataFrame, path: str, compression: str | None = None, last: int | None = None) -> None:
    """Text and date of each row, a folder per split. ``last`` spares the search for the last position."""
    fields = [F.coalesce(c, F.lit("")).alias(c) for c in ("text", "date")]
    _write_tsv(_in_order(df.select("split", "row_idx", *fields), last), path, compression)


def write_expected(df: DataFrame, path: str, compression: str | None = None, last: int | None = None) -> None:
    """The joined label set of each row, a folder per split."""
    labels = join_labels(F.col("labels")).alias("labels")
    _write_tsv(_in_order(df.select("split", "row_idx", labels), last), path, compression)


def write_tsv_pair(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Write ``path/in`` and ``path/expected`` from ``split, row_idx, text, date, labels``.

    The labels and positions are stored first: they are narrow, give the last position, and spare the
    expected file another pass over the texts.
    """
    spark = df.sparkSession
    stored = scratch_path(spark, "labels")
    narrow = materialize(df.select("split", "row_idx", "labels"), "labels", stored)
    last = last_position(narrow)
    write_inputs(df, f"{path}/in", compression, last)
    write_expected(narrow, f"{path}/expected", compression, last)
    discard(spark, stored)


def write_gzip(df: DataFrame, path: str) -> None:
    """The tab-separated pair, gzip-compressed."""
    write_tsv_pair(df, path, compression="gzip")


def write_text_lines(
    df: DataFrame, value: str | Column, path: str, compression: str | None = None
) -> None:
    """One record per line, a folder per split."""
    column = F.col(value) if isinstance(value, str) else value
    rows = _in_order(df.select("split", "row_idx", column.alias("value")), None)
    writer = rows.write.mode("overwrite").partitionBy("split").option("lineSep", "\n")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """One record of metrics as a JSON file; the frame has a single row."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_json_arrays(df: DataFrame, path: str, order_by: str = "row_idx", files: int | None = None) -> None:
    """One JSON array of objects per file, records in the order of ``order_by`` over the files and inside them.

    ``order_by`` is not written. Null fields are left out; ``files`` defaults to the shuffle partitions.
    """
    fields = [c for c in df.columns if c != order_by]
    ranged = df.repartitionByRange(files, order_by) if files else df.repartitionByRange(order_by)
    lines = ranged.sortWithinPartitions(order_by).select(F.to_json(F.struct(*fields)).alias("value"))
    lines.mapInArrow(_as_array, "value string").write.mode("overwrite").text(path)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a partition with brackets and commas around them; nothing for no lines."""
    held: pa.Array | None = None
    begin = "["
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield _lines(begin, held, ",")
            begin = ""
        held = batch.column("value")
    if held is not None:
        yield _lines(begin, held, "]")


def _lines(begin: str, values: pa.Array, end: str) -> pa.RecordBatch:
    lines = [f"{v}," for v in values.to_pylist()]
    lines[0], lines[-1] = begin + lines[0], (lines[-1] if len(lines) > 1 else begin + lines[-1])[:-1] + end
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
