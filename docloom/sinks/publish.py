"""The published layout: renamed splits, withheld test labels, header files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import config
from docloom.functions.labels import join_labels
from docloom.functions.text import strip_cr
from docloom.sinks.files import last_position, write_expected, write_inputs, write_text_lines
from docloom.sources.gzip_members import listing


def publish_view(df: DataFrame, public: bool = True, withheld: str = "test") -> DataFrame:
    """Rows as published: folder names for splits, no carriage returns, labels as a string.

    In the public copy the labels of the withheld split are null.
    """
    names = F.create_map(*[F.lit(x) for item in config.PUBLISHED_NAMES.items() for x in item])
    labels = strip_cr(join_labels(F.col("labels")))
    if public:
        labels = F.when(F.col("split") != withheld, labels)
    return df.select(
        F.element_at(names, F.col("split")).alias("split"),
        "row_idx",
        strip_cr(F.col("text")).alias("text"),
        strip_cr(F.col("date")).alias("date"),
        labels.alias("labels"),
    )


def header_rows(spark: SparkSession) -> DataFrame:
    """The two header lines, ``(file, line)``."""
    lines = {"in-header": config.IN_HEADER, "out-header": config.EXPECTED_HEADER}
    rows = [(name, "\t".join(columns)) for name, columns in lines.items()]
    return spark.createDataFrame(rows, "file string, line string")


def publish_layout(
    df: DataFrame, path: str, public: bool = True, predictions: DataFrame | None = None
) -> None:
    """Write the gzip-compressed layout and its headers under ``path``, replacing what is there.

    The public copy has no labels for the withheld split. ``predictions`` (split, row_idx, labels
    array) adds an ``out`` folder.
    """
    view = publish_view(df, public)
    last = last_position(df)
    write_inputs(view, f"{path}/in", "gzip", last)
    shown = view.where(F.col("labels").isNotNull())
    # The writer joins label arrays; a one-element array is written as it is.
    write_expected(shown.withColumn("labels", F.array("labels")), f"{path}/expected", "gzip", last)
    if predictions is not None:
        out = publish_view(predictions.withColumns({"text": F.lit(""), "date": F.lit("")}), public=False)
        write_text_lines(out, "labels", f"{path}/out", "gzip")
    header_rows(df.sparkSession).coalesce(1).write.mode("overwrite").partitionBy("file").text(
        f"{path}/headers"
    )


def single_files(spark: SparkSession, path: str, target: str) -> None:
    """Put a published layout into one file per split and kind, as programs outside Spark read it.

    Writes ``target/<split>/in.tsv.gz``, ``expected.tsv.gz`` and, with predictions, ``out.tsv.gz``, and the two
    header files beside the splits. Part files are gzip members, so they are appended as they are, in the order
    of their numbers: bytes stream from store to store, and nothing is held or decompressed. Beside each gzip file
    goes the list of its members, by which ``scan_pairs`` reads it in many tasks.
    """
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()

    def append(folder: str, file: str) -> None:
        source, out = hadoop.fs.Path(folder), hadoop.fs.Path(file)
        fs = source.getFileSystem(conf)
        if not fs.exists(source):
            return
        found = [s for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")]
        found.sort(key=lambda s: int(s.getPath().getName().split("-")[1]))
        stream = out.getFileSystem(conf).create(out, True)
        try:
            for part in found:
                given = fs.open(part.getPath())
                try:
                    hadoop.io.IOUtils.copyBytes(given, stream, conf, False)
                finally:
                    given.close()
        finally:
            stream.close()
        if file.endswith(".gz"):
            beside = hadoop.fs.Path(listing(file))
            listed = beside.getFileSystem(conf).create(beside, True)
            try:
                listed.write(bytearray("".join(f"{s.getLen()}\n" for s in found).encode()))
            finally:
                listed.close()

    for kind in ("in", "expected", "out"):
        for name in config.PUBLISHED_NAMES.values():
            append(f"{path}/{kind}/split={name}", f"{target}/{name}/{kind}.tsv.gz")
    for name in ("in-header", "out-header"):
        append(f"{path}/headers/file={name}", f"{target}/{name}.tsv")
