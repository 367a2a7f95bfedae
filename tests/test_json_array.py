import json
import random

import pytest

from docloom.sources import scan_documents, scan_json_array
from docloom.sources.documents import DOCUMENT_SCHEMA

TEXTS = [
    "plain",
    "",
    'quotes " and \\ and \\" and ends in a backslash \\',
    "braces { } [ ] }}} {{{ and , commas ]",
    "línea\nnew\tline   日本語 😀 " * 20,
    '{"content": "not a record"}, {',
    "x" * 3000,
    "\\" * 501 + '"' * 77,
]


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    for k, v in old.items():
        spark.conf.set(k, v)


def documents(n):
    rng = random.Random(3)
    docs = []
    for i in range(n):
        d = {"content": "".join(rng.choice(TEXTS) for _ in range(rng.randrange(4))), "date": f"d{i}", "buckets": [rng.choice(TEXTS[:4]) for _ in range(i % 3)]}
        if i % 5 == 0:
            d["extra"] = {"deep": [{"er": {"content": "no"}}, {}, "}"], "n": i}
        docs.append(dict(reversed(d.items())) if i % 2 else d)
    return docs


def rows(df):
    return [tuple(r) for r in df.orderBy("row_idx").collect()]


@pytest.mark.parametrize("ranges", [2, 9, 60])
@pytest.mark.parametrize("style", [{"ensure_ascii": False}, {"indent": 2, "separators": (",", ":")}])
def test_array_in_many_ranges_equals_the_documents(spark, tmp_path, small_ranges, ranges, style):
    docs = documents(24)
    path = tmp_path / "docs.json"
    path.write_text(json.dumps(docs, **style), encoding="utf8")
    small_ranges(path.stat().st_size // ranges)
    got = scan_json_array(spark, str(path), DOCUMENT_SCHEMA)
    assert rows(got) == [(i, d["content"], d["date"], d["buckets"]) for i, d in enumerate(docs)]
    # More tasks than files; of 60 ranges, most hold less than the longest records.
    assert spark.read.text(str(path), lineSep="{").rdd.getNumPartitions() >= ranges
    whole = spark.read.schema(DOCUMENT_SCHEMA).json(str(path), multiLine=True).collect()
    assert sorted(tuple(r) for r in whole) == sorted(r[1:] for r in rows(got))


def test_several_files_count_in_path_order(spark, tmp_path, small_ranges):
    docs = documents(12)
    for i, part in enumerate((docs[:4], [], docs[4:5], docs[5:])):
        (tmp_path / f"part-{i * 7:05d}.json").write_text(json.dumps(part, indent=i))
    for size in (4_000, 10**6):
        small_ranges(size)
        assert [r[2] for r in rows(scan_documents(spark, str(tmp_path)))] == [d["date"] for d in docs]


@pytest.mark.parametrize("size", [16, 10**6])
@pytest.mark.parametrize(
    "text",
    [
        '[{"content": "a"}, {"content": ',
        '[{"content": "a"}, {"content": "b"}',
        '[{"content": "a"} {"content": "b"}]',
        '[{"content": "a"}, {"content": "b"}],',
        '[{"content": "a"}] [{"content": "b"}]',
        '[{"content": "a"}}, {"content": "b"}]',
        '[{"content": "a}, {"content": "b"}]',
        '[1, {"content": "a"}]',
        '[{"content": a}]',
        '{"content": "a"}',
        "[",
        "none",
    ],
)
def test_broken_arrays_are_errors(spark, tmp_path, small_ranges, size, text):
    (tmp_path / "a.json").write_text(text)
    small_ranges(size)
    with pytest.raises(Exception):
        scan_json_array(spark, str(tmp_path / "a.json"), DOCUMENT_SCHEMA).collect()


def test_empty_arrays_have_no_records(spark, tmp_path):
    for i, text in enumerate(("[]", " [ \n ] ", "")):
        (tmp_path / f"{i}.json").write_text(text)
    assert rows(scan_json_array(spark, str(tmp_path), DOCUMENT_SCHEMA)) == []


def test_the_query_writes_more_files_for_a_larger_table(spark, monkeypatch):
    from docloom.catalog import queries as Q

    used, write = [], Q.write_json_arrays
    monkeypatch.setattr(Q, "write_json_arrays", lambda df, path, order_by, files: used.append(files) or write(df, path, order_by, files=files))
    few = sorted(Q.QUERIES["scan_json_array"](spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(Q, "_ARRAY_BYTES", 4096)
    many = sorted(Q.QUERIES["scan_json_array"](spark, "/root/testdata/sf0.001").collect())
    assert used[0] == 4 and used[1] > 8 and few == many
