"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through vantage-point trees.

Fingerprints are computed per Arrow batch; no text is shuffled. Exact copies and equal fingerprints
collapse before anything is compared. The fingerprint's bits are divided into blocks: two fingerprints
that differ in at most ``limit`` bits differ in at most ``limit // blocks`` bits of some block. For each
block a vantage-point tree, built on a bounded sample, divides the distinct fingerprints into shards; a
fingerprint near a boundary goes to both sides. Every shard is joined by a tree of its own, which emits
one link per member, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import vp_tree
from docloom.llm.common import stable_sample, text_bytes
from docloom.llm.components import connected_components
from docloom.llm.rows import keep_first
from docloom.session import materialize

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
BLOCKS = 3
# Distinct fingerprints that the shard trees are built on, and how many of all one shard should hold.
TREE_SAMPLE = 20_000
SHARD_SIZE = 50_000
_ROWS = 1 << 15


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """Bit i is 1 if set in over half of the shingles' XXH64; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), (ends[size - 1 :] if len(words) >= size else ends[-1:]).tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _ROWS):
        bits = np.unpackbits(hashes[i : i + _ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _fingerprints(size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, size) for t in batch.column("body").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_given"), pa.array(values.view(np.int64), pa.int64())], names=["_given", "fp"]
            )

    return of


def fingerprints(rows: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(row, fp)``: all columns but the text, and the fingerprint as a signed long. Null text: no words."""
    narrow = rows.select(F.struct(*[c for c in rows.columns if c != "text"]).alias("_given"), text_bytes().alias("body"))
    schema = narrow.select("_given", F.lit(0).cast("long").alias("fp")).schema
    return narrow.mapInArrow(_fingerprints(size), schema)


def _masks(blocks: int) -> list[np.uint64]:
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    return [np.uint64(sum(1 << bit for bit in range(a, b))) for a, b in zip(edges, edges[1:])]


def fingerprint_links(distinct: DataFrame, limit: int = MAX_DISTANCE, blocks: int = BLOCKS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the fingerprints connected by distances of ``limit`` or less."""
    spark = distinct.sparkSession
    masks, reach = _masks(blocks), limit // blocks
    n = distinct.count()
    sample = stable_sample(distinct.select("fp"), TREE_SAMPLE, "fp").collect()
    points = np.sort(np.array([row["fp"] for row in sample], np.int64).view(np.uint64))
    # The share of the sample that a shard of the wanted size holds.
    leaf_size = max(16.0, len(points) * shard_size / max(1, n))
    trees = [vp_tree.build(points, mask, reach, leaf_size)[0] for mask in masks]
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for block, (tree, mask) in enumerate(zip(shared.value, masks)):
                shards, places = vp_tree.route(tree, values, mask, reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(shards), block, np.int32)), pa.array(shards), pa.array(values[places].view(np.int64))],
                    names=["block", "shard", "fp"],
                )

    def join(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(shard["fp"].to_numpy())
        roots = vp_tree.link_shard(values.view(np.uint64), masks[key[0]], reach, limit)
        linked = roots != np.arange(len(values))
        return pd.DataFrame({"a": values[linked], "b": values[roots[linked]]})

    placed = distinct.select("fp").mapInArrow(place, "block int, shard int, fp long")
    return placed.groupBy("block", "shard").applyInPandas(join, "a long, b long")


def _grouped(docs: DataFrame, size: int, limit: int, blocks: int, shard_size: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, text_hash, fp)`` and distinct fingerprints ``(fp, first, group)``."""
    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    marked = materialize(fingerprints(given, size).select("_given.doc_id", "_given.text_hash", "fp"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash")
    distinct = materialize(marked.groupBy("fp").agg(F.min(first).alias("first")), "distinct-fingerprints")
    nodes = connected_components(fingerprint_links(distinct, limit, blocks, shard_size))
    grouped = distinct.join(nodes, distinct["fp"] == nodes["node"], "left")
    return marked, grouped.select("fp", "first", F.coalesce("root", "fp").alias("group"))


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE_WORDS, limit: int = MAX_DISTANCE, blocks: int = BLOCKS, shard_size: int = SHARD_SIZE
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles of ``size`` words keep their
    repeats, and a text of fewer words is one shingle. Null, empty and blank texts have fingerprint zero
    and are linked like any other. Documents link at ``limit`` or fewer differing bits; the component is
    named by the smallest doc_id reachable. Ties and repeated rows share a component, each with its own
    row; a null doc_id never names a component unless all its members are null. Other columns are ignored.
    """
    marked, grouped = _grouped(docs, size, limit, blocks, shard_size)
    names = grouped.groupBy("group").agg(F.min("first")["doc_id"].alias("component_id"))
    named = grouped.join(names, "group").select(F.col("fp").alias("named_fp"), "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, F.col("fp") == F.col("named_fp")).select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, limit: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, null last.

    Of rows that share it, the one with the smallest hash of its text stays, of rows that repeat both one. Rows
    of another text are judged by that text alone, whatever their doc_id. All columns pass through.
    """
    marked, grouped = _grouped(docs, size, limit, BLOCKS, SHARD_SIZE)
    kept = grouped.groupBy("group").agg(F.min("first").alias("first"))
    return keep_first(docs, marked, kept.select("first.doc_id", "first.text_hash"))
