"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search holds the places after the last committed boundary. A place further back than the longest piece
cannot be reached by a new step, so as soon as all paths that end in the last few places share a boundary,
the ids before it are final and their places are forgotten. Words are such boundaries by themselves, and the
ids of short ones are remembered, so that only new words are searched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import sha256_hex
from docloom.llm.pieces import PieceModel

# Characters of a chunk up to which its ids are remembered, and remembered chunks per worker.
MEMO_CHARS = 48
MEMO_CHUNKS = 300_000
# Bytes of text whose words are held at a time.
BATCH_BYTES = 1 << 20
# Places searched between two looks for a common boundary.
COMMIT_EVERY = 64


class StreamingViterbi:
    """Ids of a normalised text fed in parts: :meth:`feed` returns what has become final, :meth:`finish` the rest.

    A place's best step is one of the pieces that end there, so it is settled as soon as its character has
    come. Between calls only the places after the last committed boundary are held.
    """

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.text = ""
        # Per place: the piece that ends there, where it starts, and the best score; place 0 is the boundary.
        self.piece, self.start, self.score = [-1], [0], [0.0]

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(part), COMMIT_EVERY):
            self._settle(self.text + part[at : at + COMMIT_EVERY])
            if boundary := self._common():
                out += self._path(boundary)
                self._forget(boundary)
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.text))
        self._reset()
        return out

    def whole(self, text: str) -> list[int]:
        """Ids of a short text, from the places that it shares with the text before."""
        before, same = self.text, 0
        for a, b in zip(before, text):
            if a != b:
                break
            same += 1
        del self.piece[same + 1 :], self.start[same + 1 :], self.score[same + 1 :]
        self._settle(text)
        return self._path(len(text))

    def _settle(self, text: str) -> None:
        """Find the best step to every place of ``text`` that has none yet."""
        self.text = text
        (self._settle_scores if self.model.unigram else self._settle_pairs)(text)

    def _settle_pairs(self, text: str) -> None:
        """Byte-pair vocabulary: the one piece that stands beside the piece before it."""
        piece, start, model = self.piece, self.start, self.model
        last, stands, verdict_of, width = model.backward, model.stands, model.pairs.get, len(model.pieces)
        for end in range(len(piece), len(text) + 1):
            nodes, begin = last, end
            while begin and (node := nodes.get(text[begin - 1])) is not None:
                nodes, right = node
                begin -= 1
                if right is not None:
                    left = piece[begin]
                    verdict = verdict_of(left * width + right)
                    if verdict or verdict is None and stands(left, right):
                        piece.append(right)
                        start.append(begin)
                        break
            else:
                piece.append(-1)
                start.append(end - 1)

    def _settle_scores(self, text: str) -> None:
        """Unigram vocabulary: the best sum of scores, the longest piece among equals."""
        piece, start, score, model = self.piece, self.start, self.score, self.model
        for end in range(len(piece), len(text) + 1):
            nodes, begin, best = model.backward, end, None
            if text[end - 1] not in model.ids:
                best = (score[end - 1] + model.worst, -1, end - 1)
            while begin and (node := nodes.get(text[begin - 1])) is not None:
                nodes, right = node
                begin -= 1
                if right is not None and (best is None or score[begin] + model.scores[right] >= best[0]):
                    best = (score[begin] + model.scores[right], right, begin)
            score.append(best[0])
            piece.append(best[1])
            start.append(best[2])

    def _common(self) -> int:
        """The last boundary shared by all surviving paths: those to the places that a new piece may start from."""
        n = len(self.text)
        ends = set(range(max(0, n - self.model.longest + 1), n + 1))
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(self.start[last])
        return ends.pop()

    def _path(self, end: int) -> list[int]:
        ids: list[int] = []
        while end > 0:
            piece, begin = self.piece[end], self.start[end]
            ids += [piece] if piece >= 0 else reversed(self.model.emit(piece, self.text[begin:end]))
            end = begin
        return ids[::-1]

    def _forget(self, boundary: int) -> None:
        """Make ``boundary`` place 0; the piece before it stays, as the next one has to stand beside it."""
        self.piece, self.text = self.piece[boundary:], self.text[boundary:]
        self.start = [max(0, i - boundary) for i in self.start[boundary:]]
        if self.model.unigram:
            self.score = [x - self.score[boundary] for x in self.score[boundary:]]


class PieceEncoder(dict):
    """Chunk -> ids, of short chunks and within a bound; encodes texts with it."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model, self.search = model, StreamingViterbi(model)

    def stream(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of a normalised text given in parts, without holding the text."""
        search = StreamingViterbi(self.model)
        for part in parts:
            yield from search.feed(part)
        yield from search.finish()

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(chunk) > MEMO_CHARS:
            return tuple(self.stream([chunk]))
        ids = self[chunk] = tuple(self.search.whole(chunk))
        return ids

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text. New chunks are searched in order, so that neighbours share their first places."""
        chunks = [self.model.chunks(t) for t in texts]
        if len(self) >= MEMO_CHUNKS:
            self.clear()
        for chunk in sorted({c for found in chunks for c in found if c not in self and len(c) <= MEMO_CHARS}):
            self[chunk] = tuple(self.search.whole(chunk))
        return [list(chain.from_iterable(map(self.__getitem__, found))) for found in chunks]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]


_ENCODERS: dict[int, PieceEncoder] = {}


def broadcast_key(shared: Broadcast) -> int:
    """What tells one broadcast from another inside a worker, for as long as the worker holds it."""
    return id(shared.value)


def worker_encoder(shared: Broadcast) -> PieceEncoder:
    """One encoder per Python worker and model, so that what it remembers serves later tasks too."""
    key = broadcast_key(shared)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(shared.value)
    return _ENCODERS[key]


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of text, as its words take many times its size as Python strings."""
    for batch in batches:
        rows = max(1, int(BATCH_BYTES * batch.num_rows / max(1, batch.column("text").nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def id_lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1])))


def encode(docs: DataFrame, model: PieceModel, key: str = "doc_id") -> DataFrame:
    """``(key, ids)`` of whole texts; a null or empty text has no ids. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for part in small_batches(batches):
            rows = encoder.encode_all(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("key"), id_lists(rows)], names=["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = rows.select("key", F.array().cast("array<int>").alias("ids")).schema
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, model: PieceModel, ids: str = "ids", name: str = "text") -> DataFrame:
    """Add the text of an id array; null ids give a null text. A column of that name is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else shared.value.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_given"), pa.array(texts, pa.string())], names=["_given", "text"])

    rows = encoded.select(F.struct("*").alias("_given"), F.col(ids).alias("ids"))
    schema = rows.select("_given", F.lit("").alias("text")).schema
    done = rows.mapInArrow(run, schema)
    kept = [F.col("_given").getField(c).alias(c) for c in encoded.columns if c != name]
    return done.select(*kept, F.col("text").alias(name))


def round_trip(docs: DataFrame, model: PieceModel, key: str = "doc_id") -> DataFrame:
    """``(key, n_ids, ids, decoded_sha256, exact)``: encoded, decoded from the ids, and compared.

    ``exact`` says that the decoded text is the text. A null text counts as empty: no ids, exact.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for part in small_batches(batches):
            texts = part.column("text").to_pylist()
            rows = encoder.encode_all(texts)
            decoded = list(map(encoder.model.decode, rows))
            columns = {
                "key": part.column("key"),
                "n_ids": pa.array([len(r) for r in rows], pa.int64()),
                "ids": id_lists(rows),
                "decoded_sha256": pa.array(map(sha256_hex, decoded), pa.string()),
                "exact": pa.array([a == b for a, b in zip(decoded, texts)], pa.bool_()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = rows.select(
        "key",
        F.lit(0).cast("long").alias("n_ids"),
        F.array().cast("array<int>").alias("ids"),
        F.lit("").alias("decoded_sha256"),
        F.lit(True).alias("exact"),
    ).schema
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
