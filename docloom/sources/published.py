"""Readers of the written pairs and of the published layout, paired by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import config
from docloom.functions.labels import split_labels
from docloom.sources.text_files import scan_tsv, scan_tsv_pair

SPLITS = ("train", "test", "dev")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _pair_paths(spark: SparkSession, path: str, split: str) -> tuple[str, str] | None:
    """Where the pair of a split lies: as written by the stages, or as single files of the published layout."""
    name = config.PUBLISHED_NAMES[split]
    for pair in (
        (f"{path}/in/split={split}", f"{path}/expected/split={split}"),
        (f"{path}/in/split={name}", f"{path}/expected/split={name}"),
        (f"{path}/{name}/in.tsv.gz", f"{path}/{name}/expected.tsv.gz"),
        (f"{path}/{name}/in.tsv", f"{path}/{name}/expected.tsv"),
    ):
        if all(exists(spark, p) for p in pair):
            return pair
    return None


def scan_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(row_idx, text, date, labels, split)`` of all tab-separated pairs under ``path``.

    The label string becomes an array. A row without partner is an error, as is a folder without any pair.
    """
    frames = []
    for split in SPLITS:
        if (pair := _pair_paths(spark, path, split)) is not None:
            rows = scan_tsv_pair(spark, *pair, split)
            lone = F.raise_error(F.concat(F.lit(f"no partner in {split} for row "), F.col("row_idx").cast("string")))
            both = F.col("text").isNotNull() & F.col("labels").isNotNull()
            labels = F.when(both, split_labels(F.col("labels"))).otherwise(lone.cast("array<string>"))
            frames.append(rows.withColumn("labels", labels))
    if not frames:
        raise FileNotFoundError(f"no pair of files under {path}")
    return reduce(DataFrame.unionByName, frames)


def scan_published(spark: SparkSession, path: str, public: bool = True, withheld: str = "test") -> DataFrame:
    """``(row_idx, text, date, labels, split)`` of a published layout as it was written, labels as a string.

    Withheld labels are null; a row that lacks its partner shows as nulls.
    """
    frames = []
    for split, name in config.PUBLISHED_NAMES.items():
        texts = scan_tsv(spark, f"{path}/in/split={name}")
        if public and split == withheld:
            rows = texts.withColumn("labels", F.lit(None).cast("string"))
        else:
            rows = texts.join(scan_tsv(spark, f"{path}/expected/split={name}", ("labels",)), "row_idx", "full_outer")
        frames.append(rows.withColumn("split", F.lit(name)))
    return reduce(DataFrame.unionByName, frames)


def published_headers(spark: SparkSession, path: str) -> list[list[str]]:
    """The columns named by the two header files, inputs first."""
    return [
        spark.read.text(f"{path}/headers/file={name}", lineSep="\n").first()["value"].split("\t")
        for name in ("in-header", "out-header")
    ]
