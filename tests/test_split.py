from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.config import SplitConfig
from docloom.operators import split
from docloom.operators.row_index import global_row_index
from docloom.operators.split import (
    block_bounds,
    block_split,
    size_capped_subset,
    split_by_row_index,
    split_cuts,
    split_sizes,
)


def sizes(n, config=SplitConfig()):
    out = Counter()
    start = 0
    for split, end in block_bounds(n, config):
        out[split] += end - start
        start = end
    return dict(out)


@pytest.mark.parametrize(
    "n, parts, train, test, dev",
    [
        (200, 3, 141, 39, 20),
        (1000, 3, 700, 201, 99),
        (10000, 3, 7000, 2001, 999),
        (34290, 4, 24006, 6856, 3428),
    ],
)
def test_golden_sizes(n, parts, train, test, dev):
    assert sizes(n, SplitConfig(parts=parts)) == {"train": train, "test": test, "dev": dev}


@settings(max_examples=300, deadline=None)
@given(n=st.integers(0, 5000), parts=st.integers(1, 7))
def test_bounds_cover_every_row_once(n, parts):
    config = SplitConfig(parts=parts)
    bounds = block_bounds(n, config)
    ends = [end for _, end in bounds]
    assert ends == sorted(ends) and ends[-1] == n
    # Position by position: which block of which part does it fall into?
    block = [round(n * (r / parts)) for r in (config.train, config.test, config.dev)]
    owner = []
    for position in range(n):
        part, place = divmod(position, sum(block)) if sum(block) else (parts, 0)
        if part >= parts or place < block[0]:
            owner.append("train")
        else:
            owner.append("test" if place < block[0] + block[1] else "dev")
    spread = []
    for (split, end), start in zip(bounds, [0, *ends]):
        spread += [split] * (end - start)
    assert spread == owner


def test_ratios_are_checked_with_tolerance():
    block_bounds(10, SplitConfig(train=0.7, test=0.2, dev=0.1))  # sums to 0.9999999999999999 in some order
    with pytest.raises(ValueError):
        block_bounds(10, SplitConfig(train=0.7, test=0.2, dev=0.2))


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), "id").repartition(5)
    for partitions in (1, 4, 16):
        rows = global_row_index(df, "k", partitions=partitions).collect()
        assert [r["k"] for r in sorted(rows, key=lambda r: r["row_idx"])] == sorted(r["k"] for r in rows)
        assert sorted(r["row_idx"] for r in rows) == list(range(1000))


def test_row_index_with_a_hot_leading_key(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, F.lit("hot")).otherwise(F.hex("id")).alias("day"), "id")
    rows = global_row_index(df, ["day", "id"]).collect()
    expected = sorted((r["day"], r["id"]) for r in rows)
    assert [(r["day"], r["id"]) for r in sorted(rows, key=lambda r: r["row_idx"])] == expected


@pytest.mark.parametrize("n", [0, 1, 2, 7, 200, 1000])
def test_cuts_agree_with_positions(spark, n):
    df = spark.range(n).select((F.col("id") * 3 + 5).alias("k")).repartition(3)
    by_key = {r["k"]: r["split"] for r in block_split(df, "k").collect()}
    by_index = {
        r["k"]: r["split"] for r in split_by_row_index(global_row_index(df, "k"), n=n).collect()
    }
    assert by_key == by_index and len(by_key) == n


@pytest.mark.parametrize("n, parts", [(1000, 7), (1000, 90), (1003, 250), (40, 101), (3, 150)])
def test_many_parts(spark, n, parts):
    config = SplitConfig(parts=parts)
    spread, start = [], 0
    for name, end in block_bounds(n, config):
        spread += [name] * (end - start)
        start = end
    rows = block_split(spark.range(n).repartition(3), "id", config).collect()
    assert [r["split"] for r in sorted(rows, key=lambda r: r["id"])] == spread


def test_cuts_on_two_columns_and_as_predicate(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("a"), F.hex("id").alias("b"))
    cuts = split_cuts(df, ["a", "b"])
    marked = df.withColumn("split", cuts.column()).cache()
    ordered = sorted((r["a"], r["b"]) for r in marked.collect())
    spread, start = {}, 0
    for split, end in block_bounds(500):
        spread |= {key: split for key in ordered[start:end]}
        start = end
    assert {(r["a"], r["b"]): r["split"] for r in marked.collect()} == spread
    for split in ("train", "test", "dev"):
        same = marked.where((F.col("split") == split) != cuts.predicate(split)).count()
        assert same == 0


def test_split_does_not_shuffle_other_columns(spark, capsys):
    df = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 10))
    plan = block_split(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_split_sizes(spark):
    got = {r["split"]: r["n_rows"] for r in split_sizes(block_split(spark.range(1000), "id")).collect()}
    assert got == {"train": 700, "test": 201, "dev": 99}


def test_subsets_are_nested_and_exact(spark):
    df = spark.range(500).repartition(6)
    small = {r["id"] for r in size_capped_subset(df, 10, "id").collect()}
    large = {r["id"] for r in size_capped_subset(df.coalesce(2), 100, "id").collect()}
    assert len(small) == 10 and len(large) == 100 and small < large
    assert size_capped_subset(df, 9999, "id").count() == 500


def test_large_subsets_agree_with_small_ones(spark, monkeypatch):
    df = spark.range(500).repartition(6)
    by_top_k = {r["id"] for r in size_capped_subset(df, 60, "id").collect()}
    monkeypatch.setattr(split, "_TOP_K", 10)
    assert {r["id"] for r in size_capped_subset(df, 60, "id").collect()} == by_top_k


@pytest.mark.parametrize("parts", [3, 150])
@pytest.mark.parametrize("keys", [[1, 2, None, 4], [1, 2, 2, 3]])
def test_null_and_repeated_keys_are_refused_for_any_number_of_parts(spark, parts, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    with pytest.raises(ValueError, match="unique and not null"):
        block_split(df, "k", SplitConfig(parts=parts))
