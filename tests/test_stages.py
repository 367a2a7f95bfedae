import pytest
from pyspark.sql import functions as F

from docloom.config import EngineConfig, LanguageModelConfig, SplitConfig
from docloom.plans import stages


@pytest.fixture(scope="module")
def documents(spark):
    """Fifty documents stored out of order; every fifth is nearly empty."""
    text = F.when(F.col("id") % 5 == 0, F.lit(" \na ")).otherwise(F.concat(F.lit("text\nnumber "), F.col("id")))
    labels = F.array(F.when(F.col("id") % 2 == 0, F.lit(" Law")).otherwise(F.lit("TAX\n")))
    rows = spark.range(50).select(
        (F.col("id") * 10).alias("key"), text.alias("content"), F.lit("2020").alias("date"), labels.alias("buckets")
    )
    return rows.orderBy(F.rand(3)).repartition(4)


MAP = {"law": "law", "tax": "Taxes"}


def test_defaults():
    assert (SplitConfig().train, SplitConfig().test, SplitConfig().dev, SplitConfig().parts) == (0.7, 0.2, 0.1, 3)
    lm = LanguageModelConfig()
    assert (lm.vocab_size, lm.min_frequency, lm.max_length, lm.mlm_probability) == (16000, 2, 512, 0.15)
    assert EngineConfig().classifier.threshold == 0.5 and not EngineConfig().classifier.apply_sigmoid


def test_order_comes_from_the_key_and_the_filter_after_the_split(documents):
    rows = {r["key"]: r for r in stages.prepare(documents, MAP, key="key").collect()}
    # 50 rows in 3 parts: blocks of 12, 3 and 2, one row over.
    owner = (["train"] * 12 + ["test"] * 3 + ["dev"] * 2) * 3
    for i in range(50):
        if i % 5 == 0:
            assert i * 10 not in rows
        else:
            row = rows[i * 10]
            assert row["split"] == owner[i]
            assert row["text"] == f"text number {i}" and row["labels"] == (["law"] if i % 2 == 0 else ["taxes"])


def test_same_result_for_dense_positions(documents):
    dense = documents.withColumn("row_idx", F.col("key").cast("long") / 10).withColumn("row_idx", F.col("row_idx").cast("long"))
    a = stages.prepare(dense, MAP, dense=True).select("row_idx", "split", "text")
    b = stages.prepare(dense, MAP, key="key").select("row_idx", "split", "text")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_examples(documents):
    prepared = stages.prepare(documents, MAP, key="key").cache()
    corpus = stages.rewrite(prepared)
    assert {r["lm_text"] for r in corpus.collect()} == {"text number <number>"}
    config = LanguageModelConfig(vocab_size=280, max_length=16)
    model = stages.learn_vocabulary(corpus, config)
    rows = stages.lm_examples(corpus, model, "key", config).collect()
    assert len(rows) == 40
    for row in rows:
        assert len(row["input_ids"]) == len(row["attention_mask"]) == len(row["labels"]) == 16
        assert all(label == -100 for label, seen in zip(row["labels"], row["attention_mask"]) if not seen)
    examples = stages.classifier_examples(prepared, model, "key", EngineConfig()).collect()
    assert {tuple(r["labels"]) for r in examples} == {(1, 0), (0, 1)}
    assert all(len(r["input_ids"]) == 512 for r in examples)
    assert {r["token"]: r["n_uses"] for r in stages.census(corpus).where("split = 'dev'").collect()}["<number>"] == sum(
        r["split"] == "dev" for r in rows
    )
    score = stages.lm_score(corpus).first()
    assert score["perplexity"] > 1
