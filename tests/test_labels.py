import pytest
from pyspark.sql import functions as F

from docloom.functions import labels as L
from docloom.operators import labels as O

MAP = {"tax ": "taxes", "Law": "law", "school": "Education", "fiscal": "taxes"}
ROWS = [(0, [" TAX", "fiscal\n", "law"]), (1, []), (2, ["School"]), (3, ["LAW", "law "])]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "row_idx long, buckets array<string>")


def as_dict(df):
    return {r["row_idx"]: r["labels"] for r in df.collect()}


EXPECTED = {0: ["law", "taxes"], 1: [], 2: ["education"], 3: ["law"]}


def test_remap(rows):
    assert as_dict(O.remap_labels(rows, MAP)) == EXPECTED


def test_case_is_kept_on_demand(rows):
    assert as_dict(O.remap_labels(rows, MAP, fold_case=False))[2] == ["Education"]


@pytest.mark.parametrize("broadcast_limit", [10, 0])
def test_remap_by_join_with_and_without_slices(spark, rows, monkeypatch, broadcast_limit):
    monkeypatch.setattr(O, "MAX_LITERAL_ENTRIES", 0)
    monkeypatch.setattr(O, "MAX_BROADCAST_ENTRIES", broadcast_limit)
    folded = O.folded_label_map(spark.createDataFrame(list(MAP.items()), "raw string, canon string"))
    assert O.label_map_literal(folded, 0) is None
    assert as_dict(O.remap_labels_by_join(rows, folded, "buckets", "labels", "row_idx")) == EXPECTED


def test_unmapped_label_fails_unless_lenient(rows):
    part = {k: v for k, v in MAP.items() if k != "school"}
    with pytest.raises(Exception, match="unmapped label: School"):
        O.remap_labels(rows, part).collect()
    assert as_dict(O.remap_labels(rows, part, strict=False))[2] == []


def test_unmapped_labels_are_reported(spark, rows):
    part = spark.createDataFrame([("law", "law")], "raw string, canon string")
    got = {r["raw"]: r["n_uses"] for r in O.unmapped_labels(rows, part).collect()}
    assert got == {"tax": 1, "fiscal": 1, "school": 1}


def test_canonical_label_with_space_is_refused(rows):
    with pytest.raises(Exception, match="contains whitespace"):
        O.remap_labels(rows, {"law": "the law"}).collect()


def test_fold_strips_all_whitespace(spark):
    df = spark.createDataFrame([(" \t Law of x \n",)], "a string")
    assert df.select(L.fold_label(F.col("a"))).first()[0] == "law of x"


def test_label_strings_round_trip(spark):
    df = spark.createDataFrame([("a b",), ("",), ("a",)], "s string")
    out = df.select(L.split_labels(F.col("s")).alias("l")).select("l", L.join_labels(F.col("l")).alias("s")).collect()
    assert [(r["l"], r["s"]) for r in out] == [(["a", "b"], "a b"), ([], ""), (["a"], "a")]
    other = spark.createDataFrame([("a b, c",)], "s string").select(L.split_labels(F.col("s"), ", ")).first()[0]
    assert other == ["a b", "c"]


def test_vectors(spark):
    vocabulary = ["a", "b", "c"]
    df = spark.createDataFrame([(["c", "a", "a"],), ([],)], "l array<string>")
    hot = L.multi_hot(F.col("l"), vocabulary)
    rows = df.select(hot.alias("h"), L.decode_labels(hot, vocabulary).alias("d"), L.encode_label_ids(F.col("l"), vocabulary).alias("i")).collect()
    assert [(r["h"], r["d"], r["i"]) for r in rows] == [([1, 0, 1], ["a", "c"], [0, 2]), ([0, 0, 0], [], [])]
    with pytest.raises(Exception, match="outside the vocabulary"):
        df.select(L.encode_label_ids(F.col("l"), ["a"])).collect()


def test_threshold_is_on_the_given_score(spark):
    df = spark.createDataFrame([([0.5, 0.49, 0.0, -3.0],)], "s array<double>")
    assert df.select(L.threshold_scores(F.col("s"))).first()[0] == [1, 0, 0, 0]
    assert df.select(L.threshold_scores(F.col("s"), apply_sigmoid=True)).first()[0] == [1, 1, 1, 0]


def test_vocabulary_and_index(spark):
    df = spark.createDataFrame([(["b", "A "],), (["a"],)], "labels array<string>")
    assert O.collect_vocabulary(df) == ["a", "b"]
    index = O.label_index(O.distinct_labels(df)).collect()
    assert {r["label"]: r["idx"] for r in index} == {"a": 0, "b": 1}
    assert {r["label"]: r["n_uses"] for r in O.label_frequency(df).collect()} == {"a": 2, "b": 1}


def test_oversized_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(O, "MAX_VOCABULARY", 2)
    df = spark.createDataFrame([(["a", "b", "c"],)], "labels array<string>")
    with pytest.raises(ValueError):
        O.collect_vocabulary(df)


ODD_ROWS = [
    (1, ["law", "TAX"]),
    (1, ["school"]),
    (None, ["law"]),
    (3, None),
    (4, []),
    (4, []),
]


@pytest.mark.parametrize("limits", [(2000, 10), (0, 10), (0, 0)])
def test_every_path_gives_the_same_rows_for_null_and_repeated_keys(spark, monkeypatch, limits):
    monkeypatch.setattr(O, "MAX_LITERAL_ENTRIES", limits[0])
    monkeypatch.setattr(O.label_map_literal, "__defaults__", (limits[0],))
    monkeypatch.setattr(O, "MAX_BROADCAST_ENTRIES", limits[1])
    rows = spark.createDataFrame(ODD_ROWS, "row_idx long, buckets array<string>")
    got = sorted((tuple(r) for r in O.remap_labels(rows, MAP).collect()), key=repr)
    fold = {k.strip().lower(): v.strip().lower() for k, v in MAP.items()}
    want = [(i, None if b is None else sorted({fold[x.lower()] for x in b})) for i, b in ODD_ROWS]
    assert got == sorted(want, key=repr)
    null = spark.createDataFrame([(1, ["law", None])], "row_idx long, buckets array<string>")
    with pytest.raises(Exception, match="unmapped label: null"):
        O.remap_labels(null, MAP).collect()
    assert O.remap_labels(null, MAP, strict=False).first()["labels"] == ["law"]


def test_keys_that_fold_together_must_agree(spark, rows):
    with pytest.raises(Exception, match="two targets"):
        O.remap_labels(rows, {"Law": "law", "law ": "justice"}).collect()


def test_nan_is_below_every_threshold(spark):
    df = spark.createDataFrame([([float("nan"), 1.0],)], "s array<double>")
    assert df.select(L.threshold_scores(F.col("s"))).first()[0] == [0, 1]
