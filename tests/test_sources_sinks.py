import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import validate
from docloom.sinks import (
    header_rows,
    publish_layout,
    publish_view,
    write_gzip,
    write_metrics_json,
    write_text_lines,
    write_tsv_pair,
)
from docloom.sources import scan_documents, scan_label_map, scan_text_lines, scan_tsv, scan_tsv_pair, with_file_position

DOCS = [
    {"content": "one\ntwo", "date": "2020-01-02", "buckets": ["a", "b"]},
    {"content": "é😀", "date": "x", "buckets": []},
    {"content": "", "date": None, "buckets": ["c"]},
]

EDGE_TEXTS = [
    'say "hi" now', "'tis so", "'a' b", "a\tb", "a\rb", "NA", "null", "123", "back\\slash", '"', '""', "\\N x",
    "2021-03-04 and 1,234.5", "mail a.b@c.eu now", "see https://x.eu/y?z=1", "A4 size", "é😀", " lead and trail ",
    "#comment", 'ends with "', '"starts', "a\\", " ", " x",
]


def test_documents_from_an_array_and_from_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOCS, ensure_ascii=False), encoding="utf8")
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(d) for d in DOCS), encoding="utf8")
    for name, format in (("a.json", "json"), ("a.jsonl", "jsonl")):
        rows = scan_documents(spark, str(tmp_path / name), format).orderBy("row_idx").collect()
        assert [(r["row_idx"], r["content"], r["date"], r["buckets"]) for r in rows] == [
            (i, d["content"], d["date"], d["buckets"]) for i, d in enumerate(DOCS)
        ]


def test_blank_lines_are_no_documents(spark, tmp_path):
    for name in ("a", "b"):
        lines = ["", *(json.dumps(d) for d in DOCS[:2]), "", json.dumps(DOCS[2]), ""]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines), encoding="utf8")
    rows = scan_documents(spark, str(tmp_path), "jsonl").orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == list(range(6))
    assert [r["content"] for r in rows] == [d["content"] for d in DOCS] * 2


def test_missing_documents_are_logged(spark, tmp_path, caplog):
    empty = scan_documents(spark, str(tmp_path / "none.json"))
    assert empty.count() == 0 and "does not exist" in caplog.text
    with pytest.raises(Exception):
        scan_documents(spark, str(tmp_path / "none.json"), missing_ok=False)


def test_label_map(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a b": "x", "c": "Y"}, indent=2))
    assert {(r["raw"], r["canon"]) for r in scan_label_map(spark, str(tmp_path / "m.json")).collect()} == {("a b", "x"), ("c", "Y")}


def test_positions_over_many_files_and_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    for part in range(5):
        chunk = lines[part * 600 : (part + 1) * 600]
        # Sizes differ, so that the scan does not pack the files in path order.
        (tmp_path / f"p{part}.txt").write_text("\n".join(chunk) + "\n" * (part == 2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        scanned = spark.read.text(str(tmp_path)).where("value <> ''")
        df = with_file_position(spark.read.text(str(tmp_path)))
        assert scanned.rdd.getNumPartitions() > 8
        got = [r["value"] for r in df.orderBy("row_idx").collect()]
        numbers = [r["row_idx"] for r in df.orderBy("row_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert numbers == list(range(len(got)))
    assert [v for v in got if v] == lines


def edge_frame(spark):
    rows = [(s, i, t, "2020", ["b", "c"] if i % 3 else []) for s in ("train", "dev") for i, t in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, "split string, row_idx long, text string, date string, labels array<string>").repartition(5)


@pytest.mark.parametrize("writer", [write_tsv_pair, write_gzip])
def test_tsv_round_trip(spark, tmp_path, writer):
    path = str(tmp_path / "out")
    writer(edge_frame(spark), path)
    for split in ("train", "dev"):
        pair = scan_tsv_pair(spark, f"{path}/in/split={split}", f"{path}/expected/split={split}", split)
        rows = pair.orderBy("row_idx").collect()
        assert [r["text"] for r in rows] == EDGE_TEXTS
        assert [r["labels"] for r in rows] == ["b c" if i % 3 else "" for i in range(len(EDGE_TEXTS))]
        assert {r["date"] for r in rows} == {"2020"}
    written = sorted(Path(path).glob("in/split=train/part-*"))
    if writer is write_gzip:
        assert all(gzip.open(f).read() for f in written)


def test_written_order_with_many_partitions(spark, tmp_path):
    n = 5000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "dev").otherwise("train").alias("split"),
        (F.lit(n) - F.col("id")).alias("row_idx"),
        F.concat(F.lit("t"), F.lit(n) - F.col("id")).alias("text"),
        F.lit("d").alias("date"),
        F.array(F.concat(F.lit("l"), F.lit(n) - F.col("id"))).alias("labels"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_tsv_pair(df, str(tmp_path / "o"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for split in ("train", "dev"):
        files = sorted((tmp_path / "o" / "in" / f"split={split}").glob("part-*"))
        assert len(files) > 1
        texts = [line.split("\t")[0][1:] for f in files for line in f.read_text().splitlines()]
        labels = [line[1:] for f in sorted((tmp_path / "o" / "expected" / f"split={split}").glob("part-*")) for line in f.read_text().splitlines()]
        assert texts == labels == sorted(texts, key=int)


def test_python_csv_reads_what_we_write_and_back(spark, tmp_path):
    import csv

    path = str(tmp_path / "out")
    plain = [t for t in EDGE_TEXTS if "\r" not in t]
    rows = [("train", i, t, "d", []) for i, t in enumerate(plain)]
    schema = "split string, row_idx long, text string, date string, labels array<string>"
    write_tsv_pair(spark.createDataFrame(rows, schema).coalesce(1), path)
    lines = []
    for file in sorted(Path(path).glob("in/split=train/part-*")):
        with open(file, newline="", encoding="utf8") as handle:
            lines += [row[0] for row in csv.reader(handle, delimiter="\t")]
    assert lines == plain
    theirs = tmp_path / "theirs.tsv"
    with open(theirs, "w", encoding="utf8") as handle:
        writer = csv.writer(handle, delimiter="\t", quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
        writer.writerows([t, "d"] for t in EDGE_TEXTS)
    assert [r["text"] for r in scan_tsv(spark, str(theirs)).orderBy("row_idx").collect()] == EDGE_TEXTS


def test_text_lines(spark, tmp_path):
    df = edge_frame(spark).withColumn("text", F.translate("text", "\r", ""))
    write_text_lines(df, "text", str(tmp_path / "lm"))
    lines = scan_text_lines(spark, {s: f"{tmp_path}/lm/split={s}" for s in ("train", "dev")})
    got = [r["value"] for r in lines.where("split = 'dev'").orderBy("row_idx").collect()]
    assert got == [t.replace("\r", "") for t in EDGE_TEXTS]


def test_metrics_json(spark, tmp_path):
    write_metrics_json(spark.createDataFrame([(0.5, 0.25)], "f1 double, loss double"), str(tmp_path / "m"))
    (file,) = (tmp_path / "m").glob("part-*")
    assert json.loads(file.read_text()) == {"f1": 0.5, "loss": 0.25}


def published(spark):
    rows = [("train", 0, "a\rb", "1", ["x"]), ("dev", 0, "c", "2", []), ("test", 0, "d", "3", ["y"])]
    return spark.createDataFrame(rows, "split string, row_idx long, text string, date string, labels array<string>")


def test_publish_withholds_test_labels(spark, tmp_path):
    for public in (True, False):
        path = tmp_path / ("public" if public else "private")
        for _ in range(2):  # a second run replaces the first
            publish_layout(published(spark), str(path), public)
        names = lambda kind: {p.name for p in (path / kind).iterdir() if p.is_dir()}
        everything = {"split=train", "split=dev-0", "split=test-A"}
        assert names("in") == everything
        assert names("expected") == (everything - {"split=test-A"} if public else everything)
        headers = {f.parent.name: f.read_text() for f in path.glob("headers/*/part-*") if f.stat().st_size}
        assert headers == {"file=in-header": "InText\tTime\n", "file=out-header": "Labels\n"}
        texts = scan_tsv(spark, f"{path}/in/split=train").collect()
        assert [r["text"] for r in texts] == ["ab"]
        labels = scan_tsv(spark, f"{path}/expected/split=dev-0", ("labels",)).collect()
        assert [r["labels"] for r in labels] == [""]
    assert header_rows(spark).count() == 2


def test_publish_with_predictions(spark, tmp_path):
    predictions = published(spark).where("split <> 'train'").select("split", "row_idx", "labels")
    publish_layout(published(spark), str(tmp_path), predictions=predictions)
    out = scan_text_lines(spark, {"test-A": f"{tmp_path}/out/split=test-A"}).collect()
    assert [r["value"] for r in out] == ["y"]


def test_parity(spark):
    left = spark.createDataFrame([("dev", 0), ("dev", 1), ("train", 0)], "split string, row_idx long")
    right = spark.createDataFrame([("dev", 0), ("dev", 2), ("train", 0)], "split string, row_idx long")
    rows = {r["split"]: tuple(r)[1:] for r in validate.row_parity(left, right).collect()}
    assert rows == {"dev": (2, 2, 1, 1), "train": (1, 1, 0, 0)}
    validate.assert_row_parity(left, left)
    with pytest.raises(AssertionError, match="dev"):
        validate.assert_row_parity(left, right)


def test_validation_finds_each_fault(spark):
    view = publish_view(published(spark))
    clean = {r["check_name"]: r["n_bad"] for r in validate.validate_publish(view, ["x", "y"]).collect()}
    assert set(clean.values()) == {0} and len(clean) == 9
    faulty = spark.createDataFrame(
        [("train", "a\tb", "1\n", "x z"), ("dev-0", None, "2", None), ("test-A", "d", "3", "y"), ("other", "e", "4", "x\t")],
        "split string, text string, date string, labels string",
    )
    found = {r["check_name"]: r["n_bad"] for r in validate.validate_publish(faulty, ["x", "y"], headers=(("a",), ("b",))).collect()}
    assert found == {
        "unknown_split": 1, "missing_text": 1, "text_breaks_line": 1, "date_breaks_line": 1, "labels_break_line": 1,
        "missing_labels": 1, "leaked_labels": 1, "label_outside_vocabulary": 2, "header_arity": 1,
    }


def _line_files(tmp_path, n=40):
    folder = tmp_path / "lines"
    folder.mkdir()
    for i in range(n):
        (folder / f"part-{i:05d}.txt").write_text("".join(f"{i}-{k}\n" for k in range(50)))
    return str(folder)


@pytest.mark.parametrize("before, after", [("40", "4"), ("4", "40")])
def test_row_numbers_are_right_or_an_error_if_the_packing_changes(spark, tmp_path, before, after):
    path = _line_files(tmp_path)
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[0], before)
        numbered = scan_text_lines(spark, {"a": path})
        spark.conf.set(keys[0], after)
        # A new plan is packed by the new setting.
        again = numbered.select("*")
        try:
            rows = again.collect()
        except Exception as error:
            assert "packing changed" in str(error)
        else:
            assert sorted((r["row_idx"], r["value"]) for r in rows) == [(i * 50 + k, f"{i}-{k}") for i in range(40) for k in range(50)]
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_part_files_count_in_the_order_of_their_numbers(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in (2, 99999, 100000, 1000000):
        (folder / f"part-{i:05d}-x.txt").write_text(f"{i}\n")
    rows = scan_text_lines(spark, {"a": str(folder)}).orderBy("row_idx").collect()
    assert [r["value"] for r in rows] == ["2", "99999", "100000", "1000000"]


def test_broken_input_is_an_error(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"content": "a", "date": "d", "buckets": ["x"]}, {"content": ')
    (tmp_path / "line.jsonl").write_text('{"content": "a", "date": "d", "buckets": []}\n{"content": \n')
    (tmp_path / "map.json").write_text('{"a": ')
    (tmp_path / "wide.tsv").write_text("a\tb\tc\n")
    for read in (
        lambda: scan_documents(spark, str(tmp_path / "cut.json")),
        lambda: scan_documents(spark, str(tmp_path / "line.jsonl"), format="jsonl"),
        lambda: scan_label_map(spark, str(tmp_path / "map.json")),
        lambda: scan_tsv(spark, str(tmp_path / "wide.tsv")),
    ):
        with pytest.raises(Exception):
            read().collect()
