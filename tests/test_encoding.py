import math
from collections import Counter

from pyspark.sql import functions as F

from docloom.functions import encoding as E
from docloom.operators import ngram_lm


def test_cut_and_pad(spark):
    df = spark.createDataFrame([(list(range(10, 10 + n)),) for n in (0, 2, 4, 9)], "ids array<int>")
    wrapped = df.select(E.add_boundaries(F.col("ids"), 1, 2, 6).alias("ids"))
    rows = wrapped.select(E.pad_ids(F.col("ids"), 6, 0).alias("x"), E.attention_mask(F.col("ids"), 6).alias("m")).collect()
    assert [(r["x"], r["m"]) for r in rows] == [
        ([1, 2, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0]),
        ([1, 10, 11, 2, 0, 0], [1, 1, 1, 1, 0, 0]),
        ([1, 10, 11, 12, 13, 2], [1] * 6),
        ([1, 10, 11, 12, 13, 2], [1] * 6),
    ]


def masked(df):
    column = E.mlm_mask(F.col("ids"), F.col("id"), mask_id=8, vocab_size=16000, special_count=9)
    return {r["id"]: [tuple(m) for m in r["m"]] for r in df.select("id", column.alias("m")).collect()}


def test_masking_rates_and_independence_of_partitions(spark):
    ids = F.concat(F.array(F.lit(4)), F.transform(F.sequence(F.lit(0), F.lit(509)), lambda i: i + 100), F.array(F.lit(6)))
    df = spark.range(400).select("id", ids.alias("ids"))
    rows = masked(df)
    assert rows == masked(df.repartition(7))
    kinds = Counter()
    for row in rows.values():
        assert row[0] == (4, -100) and row[-1] == (6, -100)
        for place, (given, label) in enumerate(row[1:-1]):
            original = place + 100
            if label == -100:
                assert given == original
                kinds["left"] += 1
                continue
            assert label == original and 8 <= given < 16000
            kinds["mask" if given == 8 else "same" if given == original else "other"] += 1
    chosen = sum(kinds.values()) - kinds["left"]
    assert math.isclose(chosen / sum(kinds.values()), 0.15, abs_tol=0.005)
    assert math.isclose(kinds["mask"] / chosen, 0.8, abs_tol=0.01)
    assert math.isclose(kinds["other"] / chosen, 0.1, abs_tol=0.01)


def test_known_number_of_chosen_positions(spark):
    ids = F.array_repeat(F.lit(50), 512)
    column = E.mlm_mask(ids, F.col("id"), mask_id=8, vocab_size=16000, special_count=9)
    chosen = F.size(F.filter(column, lambda m: m["label"] != -100))
    assert spark.range(1000).agg(F.sum(chosen)).first()[0] == 76346


def test_bigram_perplexity_by_hand(spark):
    train, test = [["a", "b", "a"], ["a"]], [["a", "b"], ["c"]]
    count = lambda texts: Counter(p for t in texts for p in zip(["<s>", *t], [*t, "</s>"]))
    seen = count(train)
    context = Counter()
    for (a, _), n in seen.items():
        context[a] += n
    size = len({b for _, b in seen}) + 1
    losses = [-math.log((seen[p] + 0.5) / (context[p[0]] + 0.5 * size)) for p in count(test).elements()]
    rows = [("train", t) for t in train] + [("test", t) for t in test] + [("dev", ["a", "z"])]
    df = spark.createDataFrame(rows, "split string, t array<string>")
    row = ngram_lm.ngram_perplexity(ngram_lm.split_bigrams(df, F.col("t")), k=0.5).first()
    assert math.isclose(row["eval_loss"], sum(losses) / len(losses))
    assert math.isclose(row["perplexity"], math.exp(row["eval_loss"]))


def test_a_position_is_hashed_once_to_choose_it(spark):
    column = E.mlm_mask(F.sequence(F.lit(1), F.col("id")), F.col("id"), mask_id=8, vocab_size=16000, special_count=9)
    plan = spark.range(10).select(column.alias("m"))._jdf.queryExecution().analyzed().toString()
    # The choice, two bounds of the action and the random id.
    assert plan.count("md5(") == 4
