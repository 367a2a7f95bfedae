"""Label functions, each ``Column -> Column``. A vocabulary is a sorted Python list of labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_label(c: Column) -> Column:
    """Lower case, without leading and trailing whitespace of any kind."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def split_labels(c: Column, delimiter: str = " ") -> Column:
    """Label string to array; the empty string is the empty set."""
    quoted = F.lit(r"\Q" + delimiter + r"\E")
    return F.filter(F.split(c, quoted), lambda x: x != "")


def join_labels(labels: Column, delimiter: str = " ") -> Column:
    return F.array_join(labels, delimiter)


def dedupe_labels(labels: Column) -> Column:
    """Set semantics in a fixed order."""
    return F.array_sort(F.array_distinct(labels))


def _string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def map_literal(mapping: Mapping[str, object]) -> Column:
    """A Python dict as a map column, for lookups without a join."""
    return F.create_map(*[F.lit(part) for item in mapping.items() for part in item])


def map_labels(labels: Column, mapping: Mapping[str, str], strict: bool = True) -> Column:
    """Fold each raw label, look it up and keep the set of canonical labels.

    The lookup is a literal, so it costs no shuffle. ``strict`` fails on an unmapped label; otherwise
    such labels are dropped.
    """
    table = map_literal(mapping)

    def look_up(raw: Column) -> Column:
        found = F.element_at(table, fold_label(raw))
        if not strict:
            return found
        message = F.concat(F.lit("unmapped label: "), F.coalesce(raw, F.lit("null")))
        return F.coalesce(found, F.raise_error(message))

    return dedupe_labels(F.filter(F.transform(labels, look_up), lambda x: x.isNotNull()))


def encode_label_ids(labels: Column, vocabulary: Sequence[str]) -> Column:
    """Set of ordinals of the folded labels; a label outside the vocabulary is an error."""
    table = map_literal({label: i for i, label in enumerate(vocabulary)})

    def look_up(label: Column) -> Column:
        message = F.concat(F.lit("label outside the vocabulary: "), label)
        return F.coalesce(F.element_at(table, fold_label(label)), F.raise_error(message).cast("int"))

    return F.array_sort(F.array_distinct(F.transform(labels, look_up)))


def multi_hot(labels: Column, vocabulary: Sequence[str]) -> Column:
    """0/1 vector over the vocabulary."""
    return F.transform(_string_array(vocabulary), lambda v: F.array_contains(labels, v).cast("int"))


def decode_labels(vector: Column, vocabulary: Sequence[str]) -> Column:
    """Labels whose entry is 1, in vocabulary order."""
    pairs = F.arrays_zip(_string_array(vocabulary).alias("label"), vector.alias("hot"))
    return F.transform(F.filter(pairs, lambda p: p["hot"] == 1), lambda p: p["label"])


def sigmoid(scores: Column) -> Column:
    return F.transform(scores, lambda s: F.lit(1.0) / (F.lit(1.0) + F.exp(-s)))


def threshold_scores(scores: Column, threshold: float = 0.5, apply_sigmoid: bool = False) -> Column:
    """1 where the score reaches the threshold, 0 for NaN. Scores are taken as given unless told otherwise."""
    values = sigmoid(scores) if apply_sigmoid else scores
    return F.transform(values, lambda s: ((s >= threshold) & ~F.isnan(s)).cast("int"))
