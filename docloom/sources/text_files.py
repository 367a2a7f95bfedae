"""Readers of the tab-separated and line-oriented files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.gzip_members import is_splittable, member_lines
from docloom.sources.position import with_file_position

# One dialect for reading and writing. ``nullValue`` is a marker that no text equals by accident, so
# that "NA", "null" and the empty string stay what they are.
TSV_OPTIONS = {
    "sep": "\t",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "\\N",
    "lineSep": "\n",
    "encoding": "UTF-8",
    # Texts keep their outer spaces; the writer would drop them by default.
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def scan_tsv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] = ("text", "date"),
    with_position: bool = True,
) -> DataFrame:
    """A headerless tab-separated file, every column a string, with its row position.

    A line with too few or too many columns is an error. A single gzip file that lists its members is read by
    many tasks.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if isinstance(path, str) and is_splittable(spark, path):
        ddl = ", ".join(f"`{c}` string" for c in columns)
        fields = F.from_csv("line", ddl, dict(TSV_OPTIONS, mode="FAILFAST"))
        rows = member_lines(spark, path).select("row_idx", fields.alias("fields")).select("row_idx", "fields.*")
        return rows if with_position else rows.drop("row_idx")
    paths = path if isinstance(path, str) else list(path)
    df = spark.read.schema(schema).options(mode="FAILFAST", **TSV_OPTIONS).csv(paths)
    return with_file_position(df) if with_position else df


def scan_tsv_pair(spark: SparkSession, in_path: str, expected_path: str, split: str) -> DataFrame:
    """The rows of one split with their labels, paired by position.

    A full outer join on the position, so a row without partner shows as a null instead of being lost.
    """
    texts = scan_tsv(spark, in_path)
    labels = scan_tsv(spark, expected_path, ("labels",))
    return texts.join(labels, "row_idx", "full_outer").withColumn("split", F.lit(split))


def scan_text_lines(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Line corpora of several named splits as ``(split, row_idx, value)``."""
    frames = [
        with_file_position(spark.read.text(path, lineSep="\n")).withColumn("split", F.lit(split))
        for split, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, frames)
