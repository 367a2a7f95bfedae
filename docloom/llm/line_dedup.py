"""Line dedup over overlapping three-line windows, in DataFrame operations only.

Only hashes travel: every window is a row of two hashes, its document and its place. The first
occurrence of each window is found by one aggregation with a map-side part, so a passage that a third of
all documents share reaches its reducer as one row per task. Later occurrences are marked, their covered
lines are merged per document, and texts meet the covered line numbers once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Consecutive lines of a window; a text of fewer lines is one window.
WINDOW_LINES = 3


def _windows(lines: Column, size: int) -> Column:
    """Array of windows as ``(at, h1, h2)``; windows of blank lines only are left out."""

    def window(i: Column) -> Column:
        part = F.slice(lines, i + 1, F.lit(size))
        # Two independent 64-bit hashes: at 10^12 windows one alone would confuse some.
        return F.struct(
            i.alias("at"),
            F.xxhash64(part).alias("h1"),
            F.xxhash64(F.lit("second"), part).alias("h2"),
            (F.trim(F.array_join(part, "")) == "").alias("blank"),
        )

    last = F.greatest(F.size(lines) - size, F.lit(0))
    return F.filter(F.transform(F.sequence(F.lit(0), last), window), lambda w: ~w["blank"])


def later_windows(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``(doc_id, text_hash, at)`` of every window that occurs earlier, by (doc_id, place in the text)."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    exploded = keyed.select("doc_id", "text_hash", F.explode(_windows(F.col("lines"), size)).alias("w")).select(
        "doc_id", "text_hash", "w.at", "w.h1", "w.h2"
    )
    place = F.struct("doc_id", "text_hash", "at")
    first = exploded.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Windows that occur once never reach the join.
    repeated = first.where("first != last").select("h1", "h2", "first")
    return exploded.join(repeated, ["h1", "h2"]).where(place > F.col("first")).select("doc_id", "text_hash", "at")


def line_dedup(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``docs`` with ``text`` stripped of repeated windows, plus ``n_lines`` and ``n_removed``.

    Of the occurrences of a window the one in the smallest doc_id (null before all), then the smallest
    place, stays; the lines that any later occurrence covers go. Each removed line has an equal line
    that stays. A text of fewer lines than a window is one window, so a short copy becomes empty; blank
    windows never count. A null text stays null with no lines; an empty text has one blank line. Rows
    that repeat doc_id and text count as one document and get the same result. Columns named like the
    added ones are replaced; all others pass through.
    """
    covered = (
        later_windows(docs, size)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("at").alias("starts"))
        .select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"), "starts")
    )
    rows = docs.select(F.struct(*docs.columns).alias("_given"), F.xxhash64("text").alias("own_hash"))
    same = F.col("_given.doc_id").eqNullSafe(F.col("key_id")) & (F.col("own_hash") == F.col("key_hash"))
    joined = rows.join(covered, same, "left")

    text = F.col("_given.text")
    lines = F.split(text, "\n")
    removed = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1)))))
    inside = F.filter(removed, lambda i: i < F.size(lines))
    # A hash-based difference of line numbers, so that a text of very many lines stays linear.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    fixed = joined.withColumn("covered", inside)
    clean = F.when(F.col("covered").isNull(), text).otherwise(kept)
    others = [F.col("_given").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return fixed.select(
        *others,
        clean.alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
    )
