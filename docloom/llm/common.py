"""What the operators share: byte texts, word rules and a stable sample of rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# Rows in an Arrow batch: long documents and the Python strings made of them stay well below a worker's memory.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as the empty text.

    ``bytes.lower`` and ``bytes.split`` then fold A-Z only and split at 0x20 and 0x09-0x0D only, the
    rules that the word operators state.
    """
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def lower_ascii(column: Column) -> Column:
    return F.translate(column, _UPPER, _UPPER.lower())


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def uniform(*columns: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the seed and the columns alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def stable_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """About ``n`` rows, or all if there are no more: those whose key hashes below ``n`` in the row count.

    The number varies by its root only, and nothing is sorted. Rows of one key go together.
    """
    total = df.count()
    return df if total <= n else df.where(uniform(key, seed=seed) < n / total)
