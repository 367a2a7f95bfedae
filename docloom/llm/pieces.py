"""A SentencePiece vocabulary as data: pieces, scores and the rule by which pieces may follow each other.

Both encoders below are forward recursions over places of a text, with one step per piece that ends there.
For a unigram vocabulary a step adds the piece's score and the best sum wins. A byte-pair vocabulary has no
such scores: its encoding is the only sequence of pieces in which every neighbouring pair is one that
merging leaves as it is. There a step scores nothing if the pair stands and minus infinity if not, so that
exactly one path survives at each place, and it is the encoder's own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
# Pairs of pieces whose verdict is remembered.
_PAIRS = 1_000_000
# What an unknown character costs below the worst piece of a unigram vocabulary.
_UNKNOWN_PENALTY = 10.0


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    unigram: bool
    unknown: int
    # Ids of the 256 byte pieces, empty without byte fallback.
    bytes_from: list[int] = field(default_factory=list)
    hidden: frozenset[int] = frozenset()
    dummy_prefix: bool = True

    def __post_init__(self) -> None:
        skipped = self.hidden | set(self.bytes_from) | {self.unknown}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in skipped and p}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - _UNKNOWN_PENALTY
        # Pieces that hold a space mark after another character would tie words together.
        self.splits = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        # Trie over the reversed pieces: character -> (characters before it, id or None).
        self.backward = _trie({p[::-1]: i for p, i in self.ids.items()})
        self.byte_of = {i: b for b, i in enumerate(self.bytes_from)}
        self.pairs: dict[int, bool] = {}

    def __getstate__(self) -> dict:
        names = ("pieces", "scores", "unigram", "unknown", "bytes_from", "hidden", "dummy_prefix")
        return {n: getattr(self, n) for n in names}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def normalise(self, text: str) -> str:
        marked = text.replace(" ", SPACE)
        return SPACE + marked if marked and self.dummy_prefix else marked

    def chunks(self, text: str) -> list[str]:
        """Stretches of the normalised text that no piece reaches beyond."""
        normal = self.normalise(text)
        return _CHUNK.findall(normal) if self.splits else [normal] if normal else []

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best piece first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, left: int, right: int) -> bool:
        """Whether merging leaves this pair of pieces.

        The start of a text and unknown characters (-1) merge with nothing, so there the right piece only
        has to be what its own characters merge to.
        """
        key = left * len(self.pieces) + right
        verdict = self.pairs.get(key)
        if verdict is None:
            pair = ([self.pieces[left]] if left >= 0 else []) + [self.pieces[right]]
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            whole = self.ids.get("".join(pair)) if left >= 0 else None
            # A pair that makes up a reachable piece is merged into it; this spares most of the merging.
            verdict = not (whole is not None and self.stands(-1, whole)) and self.merge("".join(pair)) == pair
            self.pairs[key] = verdict
        return verdict

    def emit(self, piece: int, char: str) -> list[int]:
        """Ids of a step; an unknown character becomes its bytes, or the unknown piece."""
        if piece >= 0:
            return [piece]
        return [self.bytes_from[b] for b in char.encode("utf-8", "replace")] if self.bytes_from else [self.unknown]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, and the added leading space goes."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(["" if i in self.hidden else self.pieces[i] for i in ids])
        else:
            out = bytearray()
            for i in ids:
                if i in self.byte_of:
                    out.append(self.byte_of[i])
                elif i not in self.hidden:
                    out += self.pieces[i].encode()
            text = out.decode("utf-8", "replace")
        if self.dummy_prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


def _trie(ids: dict[str, int]) -> dict:
    root: dict = {}
    for text in sorted(ids):
        nodes = root
        for c in text[:-1]:
            nodes = nodes.setdefault(c, ({}, None))[0]
        below = nodes[text[-1]][0] if text[-1] in nodes else {}
        nodes[text[-1]] = (below, ids[text])
    return root


def load_model(path: str) -> PieceModel:
    """Read a model file on the driver; executors get the pieces, never the path.

    Unigram and byte-pair vocabularies without a character map of their own are supported.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    kind, norm = proto.trainer_spec.model_type, proto.normalizer_spec
    if kind not in (1, 2) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only unigram and byte-pair vocabularies that keep the text as it is are supported")
    kinds = [p.type for p in proto.pieces]
    by_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
    return PieceModel(
        pieces=[p.piece for p in proto.pieces],
        scores=[p.score for p in proto.pieces],
        unigram=kind == 1,
        unknown=kinds.index(2),
        bytes_from=[by_byte[b] for b in range(256)] if len(by_byte) == 256 else [],
        hidden=frozenset(i for i, k in enumerate(kinds) if k == 3),
        dummy_prefix=norm.add_dummy_prefix,
    )
