import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.operators import ngram_lm

TRAIN = ["a b c a b d", "a b c", "b b a c d e", "c a b", "e a b c d", "a a b f", "f a b c a", "g", "a b c d h i j"] * 2 + ["k l m n", "o p q"]
TEST = ["a b z", "q a b", "y y", "c d e a", ""]


def frame(spark, train, test):
    rows = [("train", t.split()) for t in train] + [("test", t.split()) for t in test]
    return ngram_lm.split_bigrams(spark.createDataFrame(rows, "split string, t array<string>"), F.col("t"))


def slow_model(train):
    """The probability of a word after a context, by the definitions."""
    pairs = Counter(p for t in train for p in zip(["<s>", *t.split()], [*t.split(), "</s>"]))
    times = Counter(pairs.values())
    y = times[1] / (times[1] + 2 * times[2]) if times[1] else 0.0
    d = {i: min(max(i - (i + 1) * y * times[i + 1] / times[i], 0), i) if times[i] else y for i in (1, 2, 3)}
    contexts, follows = defaultdict(dict), Counter()
    for (u, w), c in pairs.items():
        contexts[u][w] = c
        follows[w] += 1
    ones = Counter(follows.values())
    low = ones[1] / (ones[1] + 2 * ones[2]) if ones[1] else 0.0

    def p(u, w):
        lower = max(follows[w] - low, 0) / len(pairs) if follows[w] else 0
        lower += low * len(follows) / len(pairs) / (len(follows) + 1)
        if u not in contexts:
            return lower
        n = sum(contexts[u].values())
        kept = sum(d[min(c, 3)] for c in contexts[u].values()) / n
        c = contexts[u].get(w, 0)
        return (c - d[min(c, 3)] if c else 0) / n + kept * lower

    return p, set(follows), contexts


def test_kneser_ney_agrees_with_its_definition(spark):
    p, _, _ = slow_model(TRAIN)
    logs = [math.log(p(u, w)) for t in TEST for u, w in zip(["<s>", *t.split()], [*t.split(), "</s>"])]
    row = ngram_lm.kneser_ney_perplexity(frame(spark, TRAIN, TEST)).first()
    assert row["eval_loss"] == pytest.approx(-sum(logs) / len(logs))
    assert row["perplexity"] == pytest.approx(math.exp(row["eval_loss"]))


def test_probabilities_of_every_context_sum_to_one(spark):
    counts = frame(spark, TRAIN, []).cache()
    _, words, contexts = slow_model(TRAIN)
    model = ngram_lm.kneser_ney(counts)
    asked = [(u, w) for u in [*contexts, "never"] for w in [*words, "unseen"]]
    pairs = spark.createDataFrame(asked, "prev string, next string").join(counts, ["prev", "next"], "left")
    sums = model.probability(pairs.na.fill(0, ["n_train"])).groupBy("prev").agg(F.sum("p").alias("s"), F.min("p").alias("least")).collect()
    assert len(sums) == len(contexts) + 1
    for row in sums:
        assert row["s"] == pytest.approx(1) and row["least"] > 0


def test_kneser_ney_beats_add_k_on_held_out_documents(spark):
    from docloom.catalog import views as V
    from docloom.plans import stages

    corpus = V.corpus(spark, "/root/testdata/sf0.001").cache()
    best = stages.lm_score(corpus, smoothing="kneser_ney").first()["perplexity"]
    assert all(best < stages.lm_score(corpus, k=k).first()["perplexity"] for k in (1.0, 0.1, 0.01))
    with pytest.raises(ValueError):
        stages.lm_score(corpus, smoothing="none")


def test_without_train_or_test_bigrams(spark):
    assert ngram_lm.kneser_ney_perplexity(frame(spark, TRAIN, [])).first()["eval_loss"] is None
    assert ngram_lm.kneser_ney_perplexity(frame(spark, [], ["a"])).first()["eval_loss"] == 0.0


def test_no_table_of_words_is_broadcast(spark):
    counts = frame(spark, TRAIN, TEST)
    found = ngram_lm.kneser_ney(counts).probability(counts)
    assert found.count() == counts.count()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def slow_add_k(train, test, k):
    pairs = Counter(p for t in train for p in zip(["<s>", *t.split()], [*t.split(), "</s>"]))
    contexts = Counter()
    for (u, _), c in pairs.items():
        contexts[u] += c
    v = len({w for _, w in pairs}) + 1
    asked = [p for t in test for p in zip(["<s>", *t.split()], [*t.split(), "</s>"])]
    return sum(math.log(contexts[u] + k * v) - math.log(pairs[u, w] + k) for u, w in asked) / len(asked)


def test_add_k_takes_the_vocabulary_from_the_contexts(spark):
    for train in (TRAIN, [], [*TRAIN, "a <s> b"], [*TRAIN, "a </s> b"], [*TRAIN, "</s> <s>", "<s> <s>"]):
        counts = frame(spark, train, TEST).cache()
        for boundaries in (None, ngram_lm.BOUNDARIES):
            loss = ngram_lm.ngram_perplexity(counts, 0.5, boundaries).first()["eval_loss"]
            assert loss == pytest.approx(slow_add_k(train, TEST, 0.5), abs=1e-12)


def test_pairs_are_made_without_a_function_per_pair(spark):
    assert "lambda" not in frame(spark, TRAIN, TEST)._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_texts_without_addresses_are_the_same(spark):
    from docloom.functions import patterns as P
    from docloom.functions import text as X

    texts = ["it's 1.5 http nowww. a@b.eu, x", "see https://x.eu/y?z now", "l’eau well-known 3,000.5x -- ...", "a://b", "é漢 ٣٤ \u00a0x_y", "_%+- 'a' -b", "", "<url> <number>, <date>."]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    both = df.select(X.tokenize_words(F.col("t")).alias("a"), F.regexp_extract_all("t", F.lit(P.TOKEN), F.lit(0)).alias("b")).collect()
    assert len(both) == 9 and all(r["a"] == r["b"] for r in both)
