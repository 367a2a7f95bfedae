import sentencepiece

import __spark_entry__
import corpus_pipeline
from docloom.llm.decontamination import contamination
from docloom.llm.line_dedup import line_dedup
from docloom.llm.queries import ORACLE_SQL, PIECE_MODEL, QUERIES
from docloom.llm.quality import sampled
from check import compare, duck
from tests.llm.rows import awkward
from tests.llm.test_jaccard import slow_components
import pytest

SF_DIR = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    final = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in sampled(docs, labels).collect()}
    given = docs.where(docs["doc_id"].isin(sorted(kept)))
    texts = {r["doc_id"]: r["text"] for r in line_dedup(given).collect() if r["n_removed"] < r["n_lines"]}
    left = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    first = set(slow_components(list(texts.items())).values())
    hit = {r["doc_id"] for r in contamination(left, items).where("contaminated").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert final == {d: library.encode(t) for d, t in texts.items() if d in first - hit}


def test_stages_keep_the_columns_of_documents(spark):
    docs = awkward(spark).selectExpr("doc_id", "text", "row as lang", "body as source", "cast(hits as long) as n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    # Long and foreign texts come through, and the text without an id; of copies, blank texts too, one at most.
    left = [r["doc_id"] for r in corpus_pipeline.encoding(spark, docs, SF_DIR).collect()]
    assert set(left) >= {6, 10, None} and len(set(left) & {1, 2}) <= 1 and len(set(left) & {3, 4, 5}) <= 1
    assert len([d for d in left if d is not None]) == len({d for d in left if d is not None}) and left.count(None) <= 2


def test_no_stage_loses_a_text_of_a_repeated_or_missing_id(spark):
    words = [" ".join(f"{t}{k}" for k in range(250)) for t in "abcde"]
    rows = [(1, words[0]), (None, words[0]), (None, words[1]), (2, words[2]), (2, words[3]), (2, words[3]), (None, words[4])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted(r["text"] for r in docs.collect() if r["text"]) == words


def test_every_operator_has_a_query():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, monkeypatch, name):
    from docloom.catalog import ORACLE_SQL as base, QUERIES as base_queries

    monkeypatch.setitem(base_queries, name, QUERIES[name])
    monkeypatch.setitem(base, name, ORACLE_SQL[name])
    assert compare(spark, duck(SF_DIR), name, SF_DIR) is None
