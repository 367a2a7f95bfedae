"""Readers of raw documents and of the label map."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.json_array import scan_json_array
from docloom.sources.position import with_file_position

log = logging.getLogger(__name__)

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("buckets", T.ArrayType(T.StringType())),
    ]
)


def scan_documents(
    spark: SparkSession,
    path: str,
    format: str = "json",
    with_position: bool = True,
    missing_ok: bool = True,
) -> DataFrame:
    """Documents ``(row_idx, content, date, buckets)`` in file order.

    ``format`` is ``json`` (one array of objects per file, read in byte ranges), ``jsonl`` or ``parquet``.
    A missing file is logged and gives no rows, unless ``missing_ok`` is off. Broken JSON is an error,
    never a null document.
    """
    reader = spark.read.schema(DOCUMENT_SCHEMA).option("mode", "FAILFAST")
    try:
        if format == "json":
            df = scan_json_array(spark, path, DOCUMENT_SCHEMA)
            return df if with_position else df.drop("row_idx")
        elif format == "jsonl":
            df = reader.json(path)
        elif format == "parquet":
            df = reader.parquet(path)
        else:
            raise ValueError(f"unknown document format: {format}")
    except AnalysisException as error:
        if not missing_ok or error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.error("File %s does not exist", path)
        schema = T.StructType([T.StructField("row_idx", T.LongType())] if with_position else [])
        return spark.createDataFrame([], T.StructType(schema.fields + DOCUMENT_SCHEMA.fields))
    return with_file_position(df) if with_position else df


def scan_label_map(spark: SparkSession, path: str) -> DataFrame:
    """A flat JSON object as rows ``(raw, canon)``; anything else is an error."""
    text = spark.read.text(path, wholetext=True)
    broken = F.raise_error(F.lit("the label map is not a JSON object"))
    entries = F.coalesce(F.from_json("value", "map<string,string>"), broken.cast("map<string,string>"))
    return text.select(F.explode(entries).alias("raw", "canon"))
