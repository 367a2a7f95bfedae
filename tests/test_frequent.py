import random
from collections import Counter

import pytest

from docloom.operators import frequent, profile
from docloom.operators.frequent import Summary, top_items


def expected(lists, k):
    counts = Counter(i for items in lists if items for i in items if i is not None)
    return sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:k]


def skewed(n, seed=1):
    rng = random.Random(seed)
    return [[f"i{int(rng.paretovariate(0.9)) % 500}" for _ in range(rng.randrange(30))] for _ in range(n)]


def test_a_summary_is_too_low_by_what_it_took_at_most():
    lists = skewed(300)
    summary, true = Summary(20), Counter()
    for items in lists:
        counts = Counter(items)
        true.update(counts)
        summary.add(list(counts), list(counts.values()))
    summary.cut()
    assert len(summary.counts) <= 20 and summary.taken > 0
    assert all(n - summary.taken <= summary.counts.get(i, 0) <= n for i, n in true.items())


@pytest.mark.parametrize("counters", [1, 4, 16, 64, 1 << 18])
def test_top_items_agree_with_counting(spark, counters, monkeypatch):
    lists = [*skewed(400), None, [], [None, "i1"]]
    df = spark.createDataFrame([(x,) for x in lists], "items array<string>").repartition(5)
    for k in (1, 5, 20):
        assert [tuple(r) for r in top_items(df, "items", k, counters=counters).collect()] == expected(lists, k)


@pytest.mark.parametrize("most", [8, 1 << 20])
def test_ties_at_the_border_go_by_item(spark, most):
    lists = [[f"t{i:03d}", "often"] for i in range(200)] * 2 + [["t150"], ["t020"]]
    df = spark.createDataFrame([(x,) for x in lists], "items array<string>").repartition(7)
    rows = [tuple(r) for r in top_items(df, "items", 6, counters=2, most_counters=most).collect()]
    assert rows == expected(lists, 6) and rows[1:3] == [("t020", 3), ("t150", 3)] and rows[3] == ("t000", 2)


def test_nothing_to_count(spark):
    assert top_items(spark.createDataFrame([], "items array<string>"), "items", 3).collect() == []
    assert top_items(spark.createDataFrame([(None,), ([],)], "items array<string>"), "items", 3, counters=1).collect() == []


def test_shuffled_rows_are_bounded_by_the_counters(spark, monkeypatch):
    kept = []
    write = frequent.materialize
    monkeypatch.setattr(frequent, "materialize", lambda df, name: kept.append(write(df, name)) or kept[-1])
    lists = [["a", "b"] * 30 + [f"x{i}-{j}" for j in range(20)] for i in range(100)]
    df = spark.createDataFrame([(x,) for x in lists], "items array<string>").repartition(4)
    assert [tuple(r) for r in top_items(df, "items", 2, counters=10).collect()] == [("a", 3000), ("b", 3000)]
    assert len(kept) == 1 and kept[0].count() <= 4 * 10 + 1


def test_words_and_bigrams_equal_the_full_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    words, pairs = profile.word_frequency(docs), profile.bigram_frequency(docs)
    for few in (50, 1 << 18):
        assert profile.frequent_words(docs, counters=few).collect() == profile.top_words(words).collect()
        assert profile.frequent_bigrams(docs, counters=few).collect() == profile.top_bigrams(pairs).collect()


def test_top_lists_count_in_one_pass_without_python(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    monkeypatch.setattr(profile, "top_items", None)
    for made, full in ((profile.frequent_words(docs), profile.top_words(profile.word_frequency(docs))), (profile.frequent_bigrams(docs), profile.top_bigrams(profile.bigram_frequency(docs)))):
        assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.columns == full.columns and made.collect() == full.collect()
