import gzip
import json

import pytest

from docloom.__main__ import main
from docloom.catalog.views import LABEL_MAP, raw_documents


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = raw_documents(spark, "/root/testdata/sf0.001").orderBy("doc_id").drop("doc_id").toPandas()
    rows = [{"content": d.content, "date": d.date, "buckets": list(d.buckets)} for d in docs.itertuples()]
    (root / "docs.json").write_text(json.dumps(rows), encoding="utf8")
    (root / "map.json").write_text(json.dumps(LABEL_MAP), encoding="utf8")
    run = lambda *args: main([str(a) for a in args], spark)
    run("ingest", "--input", root / "docs.json", "--output", root / "documents")
    run("prepare", "--input", root / "documents", "--label-map", root / "map.json", "--output", root / "prepared")
    return root, run


def lines(folder):
    return [line for f in sorted(folder.glob("part-*")) for line in f.read_text(encoding="utf8").splitlines()]


def test_unmapped_labels_stop_the_stage(work):
    root, run = work
    (root / "small.json").write_text(json.dumps({"en": "law"}), encoding="utf8")
    with pytest.raises(SystemExit, match="unmapped labels: .*quality"):
        run("prepare", "--input", root / "documents", "--label-map", root / "small.json", "--output", root / "x")


def test_prepare(work):
    root, _ = work
    counts = {s: len(lines(root / "prepared" / "in" / f"split={s}")) for s in ("train", "test", "dev")}
    assert sum(counts.values()) == 196
    assert counts == {s: len(lines(root / "prepared" / "expected" / f"split={s}")) for s in counts}


def test_rewrite_and_language_model(work):
    root, run = work
    run("rewrite", "--input", root / "prepared/parquet", "--output", root / "corpus")
    assert sum(len(lines(root / "corpus/lm" / f"split={s}")) for s in ("train", "test", "dev")) == 196
    run("language-model", "--input", root / "corpus/parquet", "--output", root / "lm", "--vocab-size", "290")
    (scores,) = map(json.loads, lines(root / "lm/scores"))
    assert scores["perplexity"] > 1 and len(lines(root / "lm/vocab")) == 290


def test_classify_and_predict(work, spark):
    root, run = work
    run("classify", "--input", root / "prepared/parquet", "--output", root / "classifier", "--family", "naive_bayes")
    (scores,) = map(json.loads, lines(root / "classifier/scores"))
    assert set(scores) == {"f1", "accuracy", "precision", "recall", "loss"}
    run("predict", "--model", root / "classifier/model", "--output", root / "answers", "one text", "another text")
    answers = [json.loads(line) for line in lines(root / "answers")]
    assert {a["text"] for a in answers} == {"one text", "another text"} and "labels" in answers[0]


def test_describe_and_publish(work):
    root, run = work
    run("describe", "--input", root / "prepared/parquet", "--output", root / "profile")
    assert json.loads(lines(root / "profile/corpus_count")[0]) == {"n_docs": 196}
    assert len(lines(root / "profile/top_words")) == 20
    run("publish", "--input", root / "prepared/parquet", "--output", root / "published")
    assert not (root / "published/public/expected/split=test-A").exists()
    assert (root / "published/private/expected/split=test-A").exists()


def test_single_files_and_their_way_back(work, spark):
    root, run = work
    run("classify", "--input", root / "prepared/parquet", "--output", root / "c2", "--family", "naive_bayes")
    run("publish", "--input", root / "prepared/parquet", "--output", root / "p2", "--single-files", "--predictions", root / "c2/predictions")
    files = root / "p2/private-files"
    assert (files / "in-header.tsv").read_text().strip() == "InText\tTime"
    n_lines = {}
    for split in ("train", "dev-0", "test-A"):
        with gzip.open(files / split / "in.tsv.gz", "rt", encoding="utf8", newline="\n") as a:
            n_lines[split] = len(a.read().splitlines())
        with gzip.open(files / split / "expected.tsv.gz", "rt", encoding="utf8", newline="\n") as b:
            assert len(b.read().split("\n")) - 1 == n_lines[split]
    assert sum(n_lines.values()) == 196 and not (root / "p2/public-files/test-A/expected.tsv.gz").exists()
    assert (files / "test-A/out.tsv.gz").exists()
    run("ingest", "--format", "tsv", "--input", files, "--output", root / "back")
    back, stored = spark.read.parquet(str(root / "back")), spark.read.parquet(str(root / "prepared/parquet"))
    key = lambda df: sorted((r["split"], r["text"], r["date"], tuple(r["labels"])) for r in df.collect())
    assert key(back) == key(stored)
    run("describe", "--input", root / "back", "--output", root / "profile2")
    assert json.loads(lines(root / "profile2/corpus_count")[0]) == {"n_docs": 196}
