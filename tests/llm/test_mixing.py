import math
import re

import pytest

from docloom.llm.mixing import mix, mixed, mixing_targets, systematic_copies
from tests.llm.rows import awkward, empty, plain

SCHEMA = "doc_id long, source string, size long"


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    """Reshare the excess until no target is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, stopped, rest = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while rest > 1e-9 and len(stopped) < len(names):
        open_ = [s for s in names if s not in stopped]
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        over = [s for s in open_ if target[s] > limit * sizes[s]]
        rest = sum(target[s] - limit * sizes[s] for s in over)
        for s in over:
            target[s] = limit * sizes[s]
        stopped |= set(over)
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 1000, "c": 10, None: 400},
        {"é": 1, "Z": 100_000, "a": 3, "b": 30, "c": 300, "d": 3000, "": 7},
        {"only": 12},
        {"a": 0, "b": 0},
        {"a": 0, "b": 9},
    ],
)
def test_targets_agree_with_resharing(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing_targets(rows).collect()}
    assert got == pytest.approx(slow_targets(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def documents():
    return [(i, ["a", "b", "c", None][(i * i) % 7 % 4], (i * 37) % 211 + (5000 if i == 11 else 0)) for i in range(800)]


def test_words_taken_come_near_the_target(spark):
    rows = mix(spark.createDataFrame(documents(), SCHEMA)).collect()
    assert len(rows) == 800
    for source in ("a", "b", "c", None):
        own = [r for r in rows if r["source"] == source]
        taken = sum(r["copies"] * r["size"] for r in own)
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
        rate = own[0]["target"] / own[0]["source_size"]
        assert {r["copies"] for r in own} <= {math.floor(rate), math.ceil(rate)}


def test_copies_do_not_depend_on_the_partitions(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    base = plain(mix(df).select("doc_id", "copies"))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert plain(mix(df.repartition(11)).select("doc_id", "copies")) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert plain(mix(df, seed=12).select("doc_id", "copies")) != base


def test_copies_cross_integer_boundaries_of_uneven_expectations(spark):
    rows = [("s" if i % 3 else "t", i, (i * 13 % 29) / 7) for i in range(500)]
    df = spark.createDataFrame(rows, "source string, i long, expected double")
    got = {r["i"]: r["copies"] for r in systematic_copies(df, ["i"]).collect()}
    for source in ("s", "t"):
        total = drawn = 0
        for s, i, e in rows:
            if s == source:
                total, drawn = total + e, drawn + got[i]
                # At every place the copies so far are the expected sum, rounded one way or the other.
                assert abs(drawn - total) < 1
                assert math.floor(e) <= got[i] <= math.ceil(e)


def test_mixed_repeats_documents(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "y"), (3, "e f", "y")], "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["copies"] for r in mix(docs).collect()}
    texts = [r["doc_id"] for r in mixed(docs).collect()]
    assert {d: texts.count(d) for d in taken} == taken and mixed(docs).columns == docs.columns


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "if(doc_id > 5, row, null) as source", "7 as size", "8 as copies", "'t' as target", "1 as _sum")
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["copies"] <= 2
    assert plain(mix(docs)) == plain(mix(docs.repartition(5)))
    nothing = empty(spark).withColumnRenamed("row", "source")
    assert mix(nothing).count() == 0 and mixed(nothing).count() == 0
