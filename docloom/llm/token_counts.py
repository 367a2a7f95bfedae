"""Token counts by a trie of the distinct pre-tokens that shares the forward recursion of equal prefixes.

A node is a prefix. Its forward state (best score, last piece, number of pieces) depends on its ancestors
alone, so it is computed once, when the node is made, and serves every pre-token that runs through it. The
node where a pre-token ends holds its count. Nothing is shuffled: every worker keeps a trie of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.pieces import PieceModel
from docloom.llm.piece_encoding import StreamingViterbi, broadcast_key

# Nodes and terminals held by a worker; beyond it the trie starts anew, with the same counts.
MAX_NODES = 1_000_000
# Longer pre-tokens are searched in a stream and leave no nodes.
MAX_CHARS = 48
_CODE = 1 << 21


class CountingTrie(dict):
    """Pre-token -> number of tokens; a missing pre-token is inserted into the trie."""

    def __init__(self, model: PieceModel, max_nodes: int = MAX_NODES) -> None:
        super().__init__()
        self.model, self.max_nodes = model, max_nodes
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        # Forward state per node; node 0 is the empty prefix.
        self.piece, self.score, self.count = [-1], [0.0], [0]

    def __missing__(self, token: str) -> int:
        if len(token) > MAX_CHARS:
            search = StreamingViterbi(self.model)
            return len(search.feed(token)) + len(search.finish())
        if len(self.piece) + len(self) >= self.max_nodes:
            self._clear()
        path, child = [0], self.child
        for depth, c in enumerate(token, 1):
            key = path[-1] * _CODE + ord(c)
            node = child.get(key)
            if node is None:
                node = child[key] = len(self.piece)
                self._forward(token, depth, path)
            path.append(node)
        count = self[token] = self.count[path[-1]]
        return count

    def _forward(self, token: str, depth: int, path: list[int]) -> None:
        """Append the state of the prefix of length ``depth`` from the states of its own prefixes."""
        model, best, last = self.model, None, None
        nodes, begin = model.backward, depth
        pairs, width = model.pairs, len(model.pieces)
        single = False
        # Pieces that end here, the shortest first.
        while begin > 0 and (node := nodes.get(token[begin - 1])) is not None:
            nodes, right = node
            begin -= 1
            if right is None:
                continue
            single = single or begin == depth - 1
            before = path[begin]
            if model.unigram:
                score = self.score[before] + model.scores[right]
                if best is None or score >= best:
                    best, last = score, (before, right)
                continue
            left = self.piece[before]
            verdict = pairs.get(left * width + right)
            if verdict or verdict is None and model.stands(left, right):
                best, last = 0.0, (before, right)
                break
        before, extra = path[depth - 1], 1
        if not single and (best is None or model.unigram and self.score[before] + model.worst > best):
            best, last = (self.score[before] + model.worst if model.unigram else 0.0), (before, -1)
            extra = len(model.emit(-1, token[depth - 1]))
        self.piece.append(last[1])
        self.score.append(best)
        self.count.append(self.count[last[0]] + extra)

    def count_text(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a whole text."""
        chunks = self.model.chunks(text)
        return len(chunks), sum(map(self.__getitem__, chunks))


_TRIES: dict[int, CountingTrie] = {}


def token_counts(docs: DataFrame, model: PieceModel, key: str = "doc_id") -> DataFrame:
    """``(key, n_chars, n_pretokens, n_tokens)`` of whole texts.

    A null or empty text counts zero everywhere. Every row is counted, repeated ones too; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = broadcast_key(shared)
        if name not in _TRIES:
            _TRIES.clear()
            _TRIES[name] = CountingTrie(shared.value)
        trie = _TRIES[name]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [trie.count_text(t) for t in texts]
            columns = [pa.array([len(t) for t in texts], pa.int64())]
            columns += [pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", "n_chars", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    zero = F.lit(0).cast("long")
    schema = rows.select("key", *[zero.alias(c) for c in ("n_chars", "n_pretokens", "n_tokens")]).schema
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
