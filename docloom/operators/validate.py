"""Row parity and structural checks of the published layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import config
from docloom.functions.labels import split_labels


def row_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per split: rows on each side and rows without partner. Only the keys are joined."""
    keys = ["split", "row_idx"]
    a = left.select(*keys, F.lit(1).alias("_a"))
    b = right.select(*keys, F.lit(1).alias("_b"))
    return (
        a.join(b, keys, "full_outer")
        .groupBy("split")
        .agg(
            F.count("_a").alias("n_in"),
            F.count("_b").alias("n_expected"),
            F.count(F.when(F.col("_b").isNull(), 1)).alias("only_in"),
            F.count(F.when(F.col("_a").isNull(), 1)).alias("only_expected"),
        )
    )


def assert_row_parity(left: DataFrame, right: DataFrame) -> None:
    """Fail with the counts if any row lacks its partner; there is one row per split to look at."""
    bad = row_parity(left, right).where("only_in > 0 or only_expected > 0").collect()
    if bad:
        detail = ", ".join(f"{r['split']}: {r['n_in']} and {r['n_expected']}" for r in bad)
        raise AssertionError(f"rows of inputs and labels differ, got {detail}")


def validate_publish(
    view: DataFrame,
    vocabulary: Sequence[str],
    public: bool = True,
    withheld: str = config.PUBLISHED_NAMES["test"],
    headers: Sequence[Sequence[str]] = (config.IN_HEADER, config.EXPECTED_HEADER),
) -> DataFrame:
    """One row ``(check_name, n_bad)`` per check over a published view, in a single pass.

    ``view`` carries split, row_idx, text, date and labels (string, null where withheld); read it from the
    written files to check those, with their ``headers``. Every check counts rows: a row with several unknown
    labels counts once, and one whose partner is missing shows as missing text or missing labels.
    """
    folders = list(config.PUBLISHED_NAMES.values())
    known = F.array(*[F.lit(v) for v in vocabulary]).cast("array<string>")
    hidden = (F.col("split") == withheld) if public else F.lit(False)

    def count_if(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    def dirty(column: str) -> Column:
        return F.col(column).rlike(r"[\t\n\r]")

    checks = {
        "unknown_split": ~F.col("split").isin(folders),
        "missing_text": F.col("text").isNull(),
        "text_breaks_line": dirty("text"),
        "date_breaks_line": dirty("date"),
        "labels_break_line": dirty("labels"),
        "missing_labels": F.col("labels").isNull() & ~hidden,
        "leaked_labels": F.col("labels").isNotNull() & hidden,
        "label_outside_vocabulary": F.size(F.array_except(split_labels(F.col("labels")), known)) > 0,
    }
    counts = view.agg(*[count_if(cond).alias(name) for name, cond in checks.items()])
    header_errors = int(len(headers[0]) != 2) + int(len(headers[1]) != 1)
    rows = [F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_bad")) for n in checks]
    rows.append(F.struct(F.lit("header_arity").alias("check_name"), F.lit(header_errors).cast("long").alias("n_bad")))
    return counts.select(F.inline(F.array(*rows)))
