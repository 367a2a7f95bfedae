import re
from collections import Counter

import pytest

from docloom.functions import patterns as P
from docloom.operators import profile

TEXTS = ["The cat sat, on 12 mats 3.", "cat sat cat", "", "7 7 7", "Dogs and CATS and dogs cat sat", "cat sat cat"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "text string")


def tokens(text):
    return re.findall(r"\d+|[A-Za-z]+|[^\sA-Za-z0-9]", text)


def kept(text):
    return [t.lower() for t in tokens(text) if t.isalnum() and t.lower() not in P.STOP_WORDS]


def as_counter(df, *keys):
    rows = [tuple(r) for r in df.collect()]
    return Counter({(row[0] if len(keys) == 1 else row[: len(keys)]): row[-1] for row in rows})


def test_lengths(docs):
    everything = Counter(len(tokens(t)) for t in TEXTS)
    words_only = Counter(len([x for x in tokens(t) if not x.isnumeric()]) for t in TEXTS)
    assert as_counter(profile.token_length_hist(docs), "n") == everything
    assert as_counter(profile.token_length_hist_nonnumeric(docs), "n") == words_only
    both = {("all", n): c for n, c in everything.items()} | {("nonnumeric", n): c for n, c in words_only.items()}
    assert as_counter(profile.length_profile(docs), "kind", "n") == both


def test_words_and_bigrams(docs):
    words = Counter(w for t in TEXTS for w in kept(t))
    pairs = Counter(" ".join(p) for t in TEXTS for p in zip(kept(t), kept(t)[1:]))
    assert as_counter(profile.word_frequency(docs), "word") == words
    assert as_counter(profile.bigram_frequency(docs), "bigram") == pairs
    assert pairs["cat sat"] == 4 and "mats cat" not in pairs
    ranked = sorted(words.items(), key=lambda kv: (-kv[1], kv[0]))
    assert [tuple(r) for r in profile.top_words(profile.word_frequency(docs), 3).collect()] == ranked[:3]


def test_top_lengths_are_distinct_lengths(docs):
    hist = profile.token_length_hist(docs)
    assert [r["n_tokens"] for r in profile.top_longest_lengths(hist, 2).collect()] == [9, 7]
    assert [tuple(r) for r in profile.top_common_lengths(hist, 1).collect()] == [(3, 3)]


def test_union_keeps_duplicates_and_count(docs):
    assert profile.corpus_count(profile.union_splits(docs, docs)).first()["n_docs"] == 2 * len(TEXTS)


def test_preview(spark):
    df = spark.range(20).withColumnRenamed("id", "row_idx").repartition(4)
    assert [r["row_idx"] for r in profile.preview(df).collect()] == [0, 1, 2, 3, 4]


def test_census(spark):
    df = spark.createDataFrame([("dev", "<url> <url> x"), ("dev", "<date>"), ("train", "")], "split string, lm_text string")
    got = {(r["split"], r["token"]): r["n_uses"] for r in profile.special_token_census(df, ["<url>", "<date>"]).collect()}
    assert got == {("dev", "<url>"): 2, ("dev", "<date>"): 1, ("train", "<url>"): 0, ("train", "<date>"): 0}
