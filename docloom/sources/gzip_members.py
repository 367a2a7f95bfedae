"""Lines of one gzip file that consists of many members, read in byte ranges by many tasks.

Hadoop's readers give a whole gzip file to one task. A file that ``sinks.single_files`` put together has a list of
its members beside it; such a file is read as plain bytes, cut where a member begins, and each member is
decompressed by itself. A file without that list, or with one that does not fit, is left to the ordinary reader.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import materialize

# How a member begins that Hadoop or Java wrote: deflate, no flags, no time. Text cannot hold these bytes, and
# compressed bytes look like them once in 2^64 places; the member would be cut short there, which is an error.
HEAD = b"\x1f\x8b\x08\x00\x00\x00\x00\x00"
# Larger members are left to the ordinary reader, which never holds one.
MAX_MEMBER_BYTES = 512 << 20
_INPUT_BYTES = 256 << 10
_BATCH_BYTES = 4 << 20
# What Java's ``trim`` takes away: the ordinary reader drops lines that are empty then.
_BLANK = bytes(range(0x21))


def listing(path: str) -> str:
    """The file beside ``path`` that lists the bytes of its members, one number a line."""
    return f"{path}.members"


def is_splittable(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a file that its list describes, of members that fit in memory."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    file, beside = hadoop.Path(path), hadoop.Path(listing(path))
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (path.endswith(".gz") and fs.exists(beside) and fs.exists(file)):
        return False
    sizes = F.col("value").try_cast("long")
    told = spark.read.text(listing(path)).agg(F.sum(sizes).alias("bytes"), F.max(sizes).alias("most")).first()
    if told["bytes"] != fs.getFileStatus(file).getLen() or told["most"] > MAX_MEMBER_BYTES:
        return False
    stream = fs.open(file)
    try:
        return bytes(stream.read() & 0xFF for _ in HEAD) == HEAD
    finally:
        stream.close()


def _members(spark: SparkSession, path: str) -> DataFrame:
    """``(_block, _seq, _tail, body)`` of every member; byte order is that of the first two columns."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    file = hadoop.Path(path)
    target = file.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(file).toUri().toString()
    # Readers choose the decompression by the name; under a name without ".gz" they see the bytes as they are.
    name = f"docloom-{hashlib.md5(target.encode()).hexdigest()}"
    options = {f"fs.viewfs.mounttable.{name}.link./members": target, "lineSep": HEAD.decode("latin-1"), "encoding": "ISO-8859-1"}
    body = F.col("value").cast("binary")
    rows = spark.read.options(**options).text(f"viewfs://{name}/members").select(
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        # Checksum and length, which end a member.
        F.substring(body, -8, 8).alias("_tail"),
        body.alias("body"),
    )
    # Nothing stands before the first member.
    return rows.where(F.length("body") > 0)


def _lines_of(body: memoryview) -> Iterator[list[bytes]]:
    """The lines of a member in lists of some MB; blank ones are left out, as the ordinary reader does."""
    inflate, rest = zlib.decompressobj(31), b""
    inflate.decompress(HEAD)
    for i in range(0, len(body), _INPUT_BYTES):
        *lines, rest = (rest + inflate.decompress(body[i : i + _INPUT_BYTES])).split(b"\n")
        yield [x for x in lines if x.strip(_BLANK)]
    if not inflate.eof or inflate.unused_data:
        raise ValueError("a gzip member is cut short or followed by other bytes")
    if rest.strip(_BLANK):
        # Members are whole files, so no line goes on in the next one.
        yield [rest]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [sum(map(len, _lines_of(memoryview(b.as_buffer())))) for b in batch.column("body")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.int64())], names=["_block", "_seq", "_tail", "_rows"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(first: int, lines: list[bytes]) -> pa.RecordBatch:
        places = pa.array(range(first, first + len(lines)), pa.int64())
        return pa.RecordBatch.from_arrays([places, pa.array(lines, pa.binary())], names=["row_idx", "line"])

    for batch in batches:
        for first, body in zip(batch.column("_offset").to_pylist(), batch.column("body")):
            held, size = [], 0
            for lines in _lines_of(memoryview(body.as_buffer())):
                held += lines
                size += sum(map(len, lines))
                if size > _BATCH_BYTES:
                    yield packed(first, held)
                    first, held, size = first + len(held), [], 0
            if held:
                yield packed(first, held)


def member_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(row_idx, line)`` of the lines of a file for which ``is_splittable`` holds, numbered over the file.

    A first pass counts the lines of every member, a second adds those before it. Both must see the same members in
    the same partitions: what changed in between is an error, never a wrong number.
    """
    members = _members(spark, path)
    counts = materialize(members.mapInArrow(_count, "_block long, _seq long, _tail binary, _rows long"), "gzip-members")
    # One row per member, so the single-partition window is small.
    before = Window.orderBy("_block", "_seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_block", "_seq", "_tail", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    changed = F.raise_error(F.lit(f"{path} or its partitions changed while its lines were being numbered")).cast("long")
    placed = members.join(F.broadcast(offsets), ["_block", "_seq", "_tail"], "left")
    numbered = placed.select(F.coalesce("_offset", changed).alias("_offset"), "body")
    return numbered.mapInArrow(_unpack, "row_idx long, line binary").select("row_idx", F.col("line").cast("string").alias("line"))
