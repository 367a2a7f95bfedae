"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Bytes of files up to which a table counts as small.
SPREAD_BYTES = 1 << 30


def stored_bytes(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def scan_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A Parquet table. With ``spread_by``, rows of a small table are spread over all cores.

    That only happens up to SPREAD_BYTES and if the scan has fewer partitions than there are cores, so it
    never shuffles a large table on however many cores; a few row groups of long texts would otherwise keep
    most cores idle.
    """
    df = spark.read.parquet(path)
    if spread_by is None or stored_bytes(spark, path) > SPREAD_BYTES:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, spread_by) if df.rdd.getNumPartitions() < cores else df
