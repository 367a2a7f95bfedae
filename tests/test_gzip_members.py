import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.sinks import publish_layout, single_files
from docloom.sources import scan_pairs, scan_tsv


@pytest.fixture
def files(spark, tmp_path):
    """Single files of awkward texts; scans are cut into ranges of 8 kB meanwhile."""
    odd = ['a "quoted" text', "", " outer spaces ", "na\\N null \\N", '"', "é ’ 漢", " ", "tab\tinside"]
    text = F.concat_ws(" ", F.element_at(F.lit(odd), (F.col("id") % len(odd) + 1).cast("int")), F.sha2(F.col("id").cast("string"), 512))
    text = F.when(F.col("id") % 10 < 8, text).otherwise(F.element_at(F.lit(odd), (F.col("id") % len(odd) + 1).cast("int")))
    split = F.when(F.col("id") % 11 == 0, "dev").otherwise("train")
    df = spark.range(5000).select(
        split.alias("split"), F.col("id").alias("row_idx"), text.alias("text"), F.lit("").alias("date"), F.array(F.lit("x")).alias("labels")
    )
    publish_layout(df, str(tmp_path / "layout"), public=False)
    single_files(spark, str(tmp_path / "layout"), str(tmp_path / "files"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    yield tmp_path / "files", df
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def rows(df):
    return sorted((r["row_idx"], r["text"], r["date"]) for r in df.collect())


def test_one_gzip_file_is_read_by_many_tasks(spark, files):
    root, given = files
    file = root / "train/in.tsv.gz"
    found = scan_tsv(spark, str(file))
    assert found.rdd.getNumPartitions() > 4
    got = rows(found)
    assert [r[1] for r in got] == [r["text"] for r in given.where("split = 'train'").orderBy("row_idx").collect()]
    assert [r[0] for r in got] == list(range(len(got)))
    pairs = scan_pairs(spark, str(root))
    assert pairs.count() == 5000 and pairs.where("split = 'dev'").count() == 455
    # The ordinary reader, where nothing lists the members or the list is of another file.
    beside = Path(f"{file}.members")
    lengths = beside.read_text().split()
    assert sum(map(int, lengths)) == file.stat().st_size and len(lengths) == 8
    Path(f"{file.parent}/.{beside.name}.crc").unlink()
    beside.write_text("\n".join(lengths[1:]))
    other = scan_tsv(spark, str(file))
    assert other.rdd.getNumPartitions() == 1 and rows(other) == got


def test_blank_lines_and_broken_members(spark, files):
    root, _ = files
    file = root / "dev-0/in.tsv.gz"

    def write(*members):
        for p in file.parent.glob(".in*"):
            p.unlink()
        file.write_bytes(b"".join(members))
        Path(f"{file}.members").write_text("\n".join(str(len(m)) for m in members))
        return scan_tsv(spark, str(file))

    one, two = gzip.compress(b"a\t1\n\n \t\nb\t2", mtime=0), gzip.compress(b"c\t3\n" * 30_000, mtime=0)
    got = rows(write(one, two))
    assert got[:3] == [(0, "a", "1"), (1, "b", "2"), (2, "c", "3")] and len(got) == 30_002
    with pytest.raises(Exception, match="gzip member is cut short|Error -|incomplete"):
        write(one, two[:-20]).collect()
    with pytest.raises(Exception, match="MALFORMED"):
        write(one, gzip.compress(b"lone\n", mtime=0)).collect()
