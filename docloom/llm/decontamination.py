"""Benchmark decontamination by a broadcast set of the test items' word windows.

The test items are read in blocks of bounded size. A block becomes a dictionary of its words and, per
window length, a hash table of its windows; that is broadcast, and every document is scanned once
against it. Further blocks are further scans of the same pass, so the size of a broadcast never grows
with the benchmark, and no row is shuffled. The driver builds one block at a time and lets it go once it is
broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import text_bytes

# Words of a window; an item of fewer words, but not none, is one window.
WINDOW = 10
# Bytes of item text in one broadcast block.
BLOCK_BYTES = 8 << 20

# A-Z become a-z, other ASCII characters but digits and a-z become spaces, bytes from 0x80 on stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def fold_words(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_FOLD).split()


@dataclass
class WindowIndex:
    """Word numbers and, per window length, the items in which a window of word numbers occurs."""

    words: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, dict[bytes, tuple[str, ...]]] = field(default_factory=dict)

    def add(self, item_id: str, text: bytes, window: int) -> None:
        ids = np.array([self.words.setdefault(w, len(self.words)) for w in fold_words(text)], np.int32)
        size = min(window, len(ids))
        table = self.windows.setdefault(size, {}) if size else {}
        for i in range(len(ids) - size + 1 if size else 0):
            key = ids[i : i + size].tobytes()
            if item_id not in (items := table.get(key, ())):
                table[key] = (*items, item_id)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Positions of hit words and the items that have a window here.

        Only places where all words of a window are words of the benchmark are looked up; the key is
        the window itself, so a hit needs no further check.
        """
        number = self.words.get
        ids = np.array([number(w, -1) for w in words], np.int32)
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        hit, items = np.zeros(len(ids), bool), set()
        for size, table in self.windows.items():
            for i in np.flatnonzero(known[size:] - known[:-size] == size) if size <= len(ids) else ():
                if found := table.get(ids[i : i + size].tobytes()):
                    hit[i : i + size] = True
                    items.update(found)
        return np.flatnonzero(hit).astype(np.int32), items


def window_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[WindowIndex]:
    """The items' windows in blocks of about ``block_bytes`` of text; an item is never split.

    An item with a null id counts under the empty id, a null text has no words.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("body"))
    total = items.agg(F.sum(F.length("body")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-total // block_bytes))
    for b in range(n_blocks):
        index = WindowIndex()
        for row in items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n_blocks)) == b).toLocalIterator():
            index.add(row["item"], bytes(row["body"]), window)
        yield index


def _mark(index: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the hits of one block to ``hits`` and ``items``."""
    for batch in batches:
        n_words, hits, items = [], [], []
        for body, old_hits, old_items in zip(*(batch.column(c).to_pylist() for c in ("body", "hits", "items"))):
            words = fold_words(body)
            new_hits, new_items = index.value.scan(words)
            n_words.append(len(words))
            hits.append(np.union1d(old_hits, new_hits).astype(np.int32) if old_hits else new_hits)
            items.append(sorted(new_items.union(old_items)))
        columns = [batch.column("_given"), batch.column("body"), pa.array(n_words, pa.int64())]
        columns += [pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["_given", "body", "n_words", "hits", "items"])


def mark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(row, body, n_words, hits, items)``: the whole row, its text's bytes and the hit word positions."""
    marked = docs.select(
        F.struct("*").alias("_given"),
        text_bytes().alias("body"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    for index in window_blocks(benchmark, window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        marked = marked.mapInArrow(lambda batches, shared=shared: _mark(shared, batches), marked.schema)
    return marked


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside any occurrence of a window. A null or wordless text has no words and
    no hits; a document without words is not contaminated. Repeated documents are each reported, and
    items with the same id count once. Without items nothing is hit. Other columns are ignored.
    """
    marked = mark_hits(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    return marked.select(
        F.col("_given.doc_id").alias("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        # The ids are sorted by code point already, which is the order of their strings.
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the stretches from the first to the last word of each run of hit words."""
    for batch in batches:
        kept = []
        for body, hits in zip(batch.column("body").to_pylist(), batch.column("hits").to_pylist()):
            if hits:
                words = [m.span() for m in _WORD.finditer(body.translate(_FOLD))]
                pieces, end = [], 0
                for i, h in enumerate(hits):
                    if i == 0 or hits[i - 1] != h - 1:
                        pieces.append(body[end : words[h][0]])
                    end = words[h][1]
                body = b"".join([*pieces, body[end:]])
            kept.append(body)
        yield pa.RecordBatch.from_arrays([batch.column("_given"), pa.array(kept, pa.binary())], names=["_given", "body"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit stretches.

    All columns and untouched texts, null ones too, stay as they are. Hits are those of the text as
    given: what lies around a removed stretch is not scanned again.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, got {remove!r}")
    marked = mark_hits(docs, benchmark, window, block_bytes)
    if remove == "documents":
        return marked.where(F.size("hits") == 0).select(*[F.col("_given").getField(c).alias(c) for c in docs.columns])
    row, body = marked.schema["_given"], T.StructField("body", T.BinaryType())
    hit = F.col("_given").getField("text")
    clean = marked.select("_given", "body", "hits").mapInArrow(_cut, T.StructType([row, body]))
    text = F.when(hit.isNotNull(), F.decode("body", "UTF-8"))
    return clean.select(*[text.alias(c) if c == "text" else F.col("_given").getField(c).alias(c) for c in docs.columns])


