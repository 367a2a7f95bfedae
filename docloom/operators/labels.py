"""Label joins, vocabulary and frequency."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import labels as L

# Largest map that is put into the plan as a literal; beyond it the labels are joined.
MAX_LITERAL_ENTRIES = 2_000
# Largest map side that is broadcast in that join, by row count.
MAX_BROADCAST_ENTRIES = 1_000_000
# Vocabularies are vector positions held by the driver; a caller with more labels passes a larger bound.
MAX_VOCABULARY = 20_000
# Slices of each raw label when both sides of the label join are large.
_SALTS = 32


def folded_label_map(label_map: DataFrame, fold_case: bool = True) -> DataFrame:
    """``(raw, canon)`` with folded keys; canonical labels are folded too unless told otherwise.

    A canonical label with whitespace inside would fall apart when label strings are split: an error, as are
    keys that fold to the same label but have different targets. Null keys match nothing and are left out.
    """
    canon = L.fold_label(F.col("canon")) if fold_case else F.col("canon")
    message = F.concat(F.lit("canonical label contains whitespace: "), F.col("canon"))
    checked = F.when(canon.isNull() | ~canon.rlike(r"\s"), canon).otherwise(F.raise_error(message).cast("string"))
    rows = label_map.select(L.fold_label(F.col("raw")).alias("raw"), checked.alias("canon")).where("raw is not null")
    targets = rows.groupBy("raw").agg(F.min("canon").alias("canon"), F.max("canon").alias("_other"))
    conflict = F.concat_ws(" ", F.lit("label has two targets:"), "raw", F.lit("to"), "canon", F.lit("and"), "_other")
    one = F.when(F.col("canon").eqNullSafe(F.col("_other")), F.col("canon"))
    return targets.select("raw", one.otherwise(F.raise_error(conflict).cast("string")).alias("canon"))


def label_map_literal(label_map: DataFrame, max_entries: int = MAX_LITERAL_ENTRIES) -> dict[str, str] | None:
    """The map as a Python dict, or None if it has more than ``max_entries`` rows."""
    rows = label_map.limit(max_entries + 1).collect()
    return {row["raw"]: row["canon"] for row in rows} if len(rows) <= max_entries else None


def remap_labels(
    df: DataFrame,
    label_map: DataFrame | Mapping[str, str],
    column: str = "buckets",
    name: str = "labels",
    strict: bool = True,
    fold_case: bool = True,
) -> DataFrame:
    """Replace the raw labels of each row by their set of canonical labels.

    A null array stays null. A null or unmapped label is an error, or is dropped if not ``strict``. A map of
    ordinary size becomes a literal lookup without any shuffle; a larger one is joined, with the same rows.
    """
    if not isinstance(label_map, DataFrame):
        label_map = df.sparkSession.createDataFrame(list(label_map.items()), "raw string, canon string")
    folded = folded_label_map(label_map, fold_case)
    mapping = label_map_literal(folded)
    if mapping is not None:
        return df.withColumn(name, L.map_labels(F.col(column), mapping, strict)).drop(column)
    return remap_by_join(df, folded, column, name, strict).drop(column)


def remap_by_join(df: DataFrame, folded: DataFrame, column: str, name: str, strict: bool = True) -> DataFrame:
    """Add the canonical labels by a join of the distinct label arrays with a large map.

    Rows are found again by their array, so neither null nor repeated keys matter, and a common array is
    looked up once. A map too large to broadcast is joined in slices of each label, so that a label of many
    arrays is spread over tasks.
    """
    arrays = df.select(F.col(column).alias("_array")).where(F.col("_array").isNotNull()).distinct()
    rows = arrays.select("_array", F.explode("_array").alias("_raw")).withColumn("raw", L.fold_label(F.col("_raw")))
    if folded.limit(MAX_BROADCAST_ENTRIES + 1).count() <= MAX_BROADCAST_ENTRIES:
        joined = rows.join(F.broadcast(folded), "raw", "left")
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_array"), F.lit(_SALTS)).cast("int"))
        slices = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt")
        joined = salted.join(folded.select("*", slices), ["raw", "_salt"], "left")
    canon = F.col("canon")
    if strict:
        message = F.concat(F.lit("unmapped label: "), F.coalesce("_raw", F.lit("null")))
        canon = F.coalesce(canon, F.raise_error(message).cast("string"))
    mapped = joined.groupBy("_array").agg(F.array_sort(F.collect_set(canon)).alias("_mapped"))
    none = F.array().cast("array<string>")
    labels = F.when(F.col(column).isNotNull(), F.coalesce("_mapped", none))
    return df.join(mapped, F.col(column) == F.col("_array"), "left").withColumn(name, labels).drop("_array", "_mapped")


def remap_labels_by_join(
    df: DataFrame, folded: DataFrame, column: str, name: str, key: str, strict: bool = True
) -> DataFrame:
    """Narrow ``(key, labels)`` of every row, by :func:`remap_by_join`."""
    return remap_by_join(df.select(key, column), folded, column, name, strict).select(key, name)


def unmapped_labels(df: DataFrame, label_map: DataFrame, column: str = "buckets") -> DataFrame:
    """Folded raw labels that the map lacks, with the number of their uses.

    The labels are counted first, so the join sees each label once.
    """
    used = (
        df.select(F.explode(column).alias("_raw"))
        .groupBy(L.fold_label(F.col("_raw")).alias("raw"))
        .agg(F.count(F.lit(1)).alias("n_uses"))
    )
    return used.join(folded_label_map(label_map).select("raw"), "raw", "left_anti")


def align(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("split", "row_idx")) -> DataFrame:
    """Pair texts, labels or predictions of the same row."""
    return left.join(right, list(keys), "inner")


def _exploded(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.transform(column, L.fold_label)).alias("label"))


def distinct_labels(df: DataFrame, column: str = "labels") -> DataFrame:
    """Every label that occurs, folded."""
    return _exploded(df, column).distinct()


def label_index(vocabulary: DataFrame) -> DataFrame:
    """``(label, idx)`` with ordinals from 0 in label order; one row per label of the vocabulary."""
    return vocabulary.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("idx"))


def collect_vocabulary(df: DataFrame, column: str = "labels", max_labels: int | None = None) -> list[str]:
    """The sorted vocabulary on the driver, for vector literals; more than ``max_labels`` are an error."""
    most = MAX_VOCABULARY if max_labels is None else max_labels
    rows = distinct_labels(df, column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    return sorted(row["label"] for row in rows)


def label_frequency(df: DataFrame, column: str = "labels") -> DataFrame:
    """Uses per folded label."""
    return _exploded(df, column).groupBy("label").agg(F.count(F.lit(1)).alias("n_uses"))
