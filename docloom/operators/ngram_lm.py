"""Bigram models with add-k and Kneser-Ney smoothing: the held-out score of the language-model stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize

# What stands before and after every text.
BOUNDARIES = ("<s>", "</s>")


def split_bigrams(
    df: DataFrame,
    tokens: Column,
    train: str = "train",
    test: str = "test",
    start: str = BOUNDARIES[0],
    end: str = BOUNDARIES[1],
) -> DataFrame:
    """``(prev, next, n_train, n_test)`` of neighbouring tokens, text boundaries included.

    Both splits are counted in one pass and one shuffle, so that no join is needed afterwards.
    """
    framed = F.concat(F.array(F.lit(start)), tokens, F.array(F.lit(end)))
    n = F.size("t")
    # Zipped natively: a lambda makes every pair one by one.
    pairs = F.arrays_zip(F.slice("t", F.lit(1), n - 1).alias("prev"), F.slice("t", F.lit(2), n - 1).alias("next"))
    rows = df.where(F.col("split").isin(train, test)).select((F.col("split") == test).alias("held"), framed.alias("t"))
    return (
        rows.select("held", F.explode(pairs).alias("pair"))
        .groupBy("pair.prev", "pair.next")
        .agg(F.count(F.when(~F.col("held"), 1)).alias("n_train"), F.count(F.when(F.col("held"), 1)).alias("n_test"))
    )


def ngram_perplexity(bigrams: DataFrame, k: float = 1.0, boundaries: tuple[str, str] | None = None) -> DataFrame:
    """``perplexity`` and ``eval_loss`` of the test bigrams under the train bigrams.

    The log-probability of a bigram is ``ln(c(prev,next)+k) - ln(c(prev)+kV)``, V being the number of
    distinct next tokens in train plus one for unseen ones. The first part is summed over the bigrams as they
    lie, the second per context, which partial aggregation does before the shuffle, so a frequent context is no
    hot key. The counts are written once to the shared scratch folder, as V and the sums read them.

    ``boundaries`` says that ``bigrams`` are all those of whole texts between these two marks. Then V follows
    from the contexts: every token stands before one and after one, so only the marks make a difference.
    """
    counts = materialize(bigrams, "bigrams")
    seen, (start, end) = F.col("n_train") > 0, boundaries or BOUNDARIES
    log = F.col("n_test") * F.ln(F.col("n_train") + F.lit(k))
    sums = counts.agg(F.sum(log).alias("upper"), F.max((F.col("next") == start) & seen).alias("start")).first()
    contexts = counts.groupBy("prev").agg(F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))
    if boundaries is None:
        v = counts.where(seen).agg(F.count_distinct("next")).first()[0] + 1
    else:
        contexts = materialize(contexts, "contexts")
        found = contexts.agg(F.count_if(seen).alias("n"), F.max((F.col("prev") == end) & seen).alias("end")).first()
        # The opening mark is a context and the closing one follows, unless a text has it as a token too.
        v = found["n"] + bool(sums["start"]) - bool(found["end"]) + 1
    lower = F.col("n_test") * F.ln(F.col("n_train") + F.lit(k * v))
    loss = contexts.agg(((F.sum(lower) - F.lit(sums["upper"] or 0.0)) / F.sum("n_test")).alias("eval_loss"))
    return loss.select(F.exp("eval_loss").alias("perplexity"), "eval_loss")


# Slices that a frequent word's bigrams are spread over when they meet its row.
_SALTS = 16


def _met(rows: DataFrame, facts: DataFrame, key: str, other: str) -> DataFrame:
    """``rows`` left-joined with ``facts`` on ``key``; rows of one key spread by their ``other`` word.

    ``facts`` grow with the vocabulary and have _SALTS rows a word here, which their size on disk does not tell: they
    are sorted, never gathered on the driver for a broadcast.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(_SALTS)).cast("int"))
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(spread.hint("merge"), [key, "_salt"], "left").drop("_salt")


@dataclass(frozen=True)
class KneserNey:
    """An interpolated Kneser-Ney bigram model as two tables and a few numbers.

    ``contexts (prev, n, kept)``: uses of a context and the share of its mass that goes to the lower order.
    ``words (next, p_next)``: the lower order, by the number of distinct words that a word follows.
    ``discounts``: taken from a bigram seen once, twice, or more often. ``p_unseen``: of a word never seen.
    """

    contexts: DataFrame
    words: DataFrame
    discounts: tuple[float, float, float]
    p_unseen: float

    def probability(self, pairs: DataFrame) -> DataFrame:
        """``pairs (prev, next, n_train, ...)`` with ``p``, the probability of the word after its context."""
        found = _met(_met(pairs, self.contexts, "prev", "next"), self.words, "next", "prev")
        one, two, more = (F.lit(d) for d in self.discounts)
        taken = F.when(F.col("n_train") == 1, one).when(F.col("n_train") == 2, two).otherwise(more)
        own = F.when(F.col("n_train") > 0, (F.col("n_train") - taken) / F.col("n")).otherwise(0.0)
        lower = F.coalesce("p_next", F.lit(self.p_unseen))
        # A context without uses leaves all to the lower order.
        return found.withColumn("p", own + F.coalesce("kept", F.lit(1.0)) * lower).drop("n", "kept", "p_next")


def kneser_ney(counts: DataFrame) -> KneserNey:
    """The model of ``counts (prev, next, n_train)``; rows without train uses are passed over.

    Discounts come from the counts of counts; where there are none to divide by, from the simple discount, and
    they never exceed the count. The lower order is discounted likewise and shares its rest evenly among all
    words and one that was never seen, so the probabilities of a context sum to one.
    """
    seen = counts.where("n_train > 0")
    times = seen.agg(*[F.count_if(F.col("n_train") == i).alias(f"n{i}") for i in range(1, 5)], F.count(F.lit(1)).alias("types")).first()
    n1, n2, n3, n4 = (times[f"n{i}"] for i in range(1, 5))
    simple = n1 / (n1 + 2 * n2) if n1 else 0.0

    def discount(i: int, below: int, above: int) -> float:
        return min(max(i - (i + 1) * simple * above / below, 0.0), float(i)) if below else simple

    discounts = (discount(1, n1, n2), discount(2, n2, n3), discount(3, n3, n4))
    follows = materialize(seen.groupBy("next").agg(F.count(F.lit(1)).alias("types")), "continuations")
    once = follows.agg(F.count_if(F.col("types") == 1).alias("n1"), F.count_if(F.col("types") == 2).alias("n2"), F.count(F.lit(1)).alias("words")).first()
    lower = once["n1"] / (once["n1"] + 2 * once["n2"]) if once["n1"] else 0.0
    types, words = max(times["types"], 1), once["words"]
    # Without any train bigram all that is left is the word never seen.
    p_unseen = lower * words / types / (words + 1) if words else 1.0
    contexts = seen.groupBy("prev").agg(
        F.sum("n_train").alias("n"),
        *[F.count_if(F.col("n_train") == i).alias(f"k{i}") for i in (1, 2)],
        F.count_if(F.col("n_train") > 2).alias("k3"),
    )
    mass = sum((F.lit(d) * F.col(f"k{i}") for i, d in enumerate(discounts, 1)), F.lit(0.0))
    return KneserNey(
        contexts.select("prev", "n", (mass / F.col("n")).alias("kept")),
        follows.select("next", ((F.col("types") - F.lit(lower)) / F.lit(float(types)) + F.lit(p_unseen)).alias("p_next")),
        discounts,
        p_unseen,
    )


def kneser_ney_perplexity(bigrams: DataFrame) -> DataFrame:
    """``perplexity`` and ``eval_loss`` of the test bigrams under an interpolated Kneser-Ney model of train.

    Bigrams are counted once and written; each distinct test bigram meets the row of its context and that of
    its word, and weighs by its uses. The loss is null without test bigrams.
    """
    counts = materialize(bigrams, "bigrams")
    scored = kneser_ney(counts).probability(counts.where("n_test > 0"))
    loss = scored.agg((-F.sum(F.col("n_test") * F.ln("p")) / F.sum("n_test")).alias("eval_loss"))
    return loss.select(F.exp("eval_loss").alias("perplexity"), "eval_loss")
