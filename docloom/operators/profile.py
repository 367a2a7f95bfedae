"""Corpus profile: length histograms, word and bigram counts, and their top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions import text as X
from docloom.operators.frequent import top_items


def union_splits(*frames: DataFrame) -> DataFrame:
    """All rows of the given splits, duplicates kept."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def corpus_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_docs"))


def length_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Both length histograms, ``(kind, n_tokens, n_docs)``, from one tokenising pass.

    ``kind`` is ``all`` or ``nonnumeric``.
    """
    tokens = df.select(X.tokenize_words(F.col(text)).alias("tokens"))
    lengths = tokens.select(
        F.size("tokens").alias("all"),
        F.size(F.filter("tokens", lambda t: ~X.is_numeric_token(t))).alias("nonnumeric"),
    )
    # Counted as pairs first: two columns per document shrink to few distinct pairs before the shuffle.
    pairs = lengths.groupBy("all", "nonnumeric").agg(F.count(F.lit(1)).alias("n_docs"))
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_tokens")) for k in ("all", "nonnumeric")]
    )
    return (
        pairs.select(F.inline(kinds), "n_docs")
        .groupBy("kind", "n_tokens")
        .agg(F.sum("n_docs").alias("n_docs"))
    )


def token_length_hist(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents per number of tokens."""
    return df.groupBy(X.count_words(F.col(text)).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def token_length_hist_nonnumeric(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents per number of tokens that are not purely numeric."""
    n = F.size(F.filter(X.tokenize_words(F.col(text)), lambda t: ~X.is_numeric_token(t)))
    return df.groupBy(n.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def word_frequency(
    df: DataFrame, text: str = "text", stop_words: Sequence[str] = P.STOP_WORDS
) -> DataFrame:
    """Counts of lower-cased letter/digit words without stop words.

    Partial aggregation absorbs frequent words before the shuffle.
    """
    words = X.kept_words(X.tokenize_words(F.col(text)), stop_words)
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_uses"))


def bigram_frequency(
    df: DataFrame, text: str = "text", stop_words: Sequence[str] = P.STOP_WORDS
) -> DataFrame:
    """Counts of neighbouring kept words; skipped tokens are no barrier, documents are."""
    kept = df.select(X.kept_words(X.tokenize_words(F.col(text)), stop_words).alias("words"))
    return (
        kept.select(F.explode(X.neighbour_pairs(F.col("words"))).alias("bigram"))
        .groupBy("bigram")
        .agg(F.count(F.lit(1)).alias("n_uses"))
    )


def most_common(counts: DataFrame, key: str, count: str, k: int) -> DataFrame:
    """The ``k`` most frequent keys; equal counts in key order."""
    return counts.orderBy(F.desc(count), F.asc(key)).limit(k)


def top_common_lengths(hist: DataFrame, k: int = 10) -> DataFrame:
    return most_common(hist, "n_tokens", "n_docs", k)


def top_longest_lengths(hist: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest distinct lengths with their document counts."""
    return hist.orderBy(F.desc("n_tokens")).limit(k)


def top_words(words: DataFrame, k: int = 20) -> DataFrame:
    return most_common(words, "word", "n_uses", k)


def top_bigrams(bigrams: DataFrame, k: int = 20) -> DataFrame:
    return most_common(bigrams, "bigram", "n_uses", k)


def frequent_words(df: DataFrame, k: int = 20, text: str = "text", stop_words: Sequence[str] = P.STOP_WORDS, **options) -> DataFrame:
    """``top_words`` of a text column, counted in one pass.

    With ``options`` of :func:`top_items` summaries take the place of a shuffle of all words, at the price of Python
    work and a second pass over the texts.
    """
    if not options:
        return top_words(word_frequency(df, text, stop_words), k)
    words = X.kept_words(X.tokenize_words(F.col(text)), stop_words)
    return top_items(df.select(words.alias("items")), "items", k, **options).withColumnRenamed("item", "word")


def frequent_bigrams(df: DataFrame, k: int = 20, text: str = "text", stop_words: Sequence[str] = P.STOP_WORDS, **options) -> DataFrame:
    """``top_bigrams`` of a text column, counted as :func:`frequent_words` counts."""
    if not options:
        return top_bigrams(bigram_frequency(df, text, stop_words), k)
    kept = df.select(X.kept_words(X.tokenize_words(F.col(text)), stop_words).alias("words"))
    pairs = kept.select(X.neighbour_pairs(F.col("words")).alias("items"))
    return top_items(pairs, "items", k, **options).withColumnRenamed("item", "bigram")


def preview(df: DataFrame, order_by: str = "row_idx", k: int = 5) -> DataFrame:
    """The first rows of a frame."""
    return df.orderBy(order_by).limit(k)


def special_token_census(df: DataFrame, tokens: Sequence[str], text: str = "lm_text") -> DataFrame:
    """Occurrences of each mask token per split, ``(split, token, n_uses)``, in one pass."""
    sums = [F.sum(F.regexp_count(text, F.lit(t))).alias(f"c{i}") for i, t in enumerate(tokens)]
    rows = F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"c{i}").alias("n_uses")) for i, t in enumerate(tokens)])
    return df.groupBy("split").agg(*sums).select("split", F.inline(rows))
