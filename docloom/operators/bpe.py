"""Byte-level byte-pair vocabulary: counting, learning and encoding.

The corpus collapses to a table of distinct words with counts. Inside that table a word is a string
with one character per symbol, so that a merge is a plain string replacement in the JVM.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import SPECIAL_TOKENS, LanguageModelConfig
from docloom.functions import encoding as E
from docloom.functions import patterns as P
from docloom.session import discard, materialize, scratch_path

# Stretches of words that a round of learning may bring to the driver, and the pairs that the first round tries.
MAX_FRAGMENTS = 200_000
_FIRST_PAIRS = 4_096
# Symbol ids become characters from here on, clear of ASCII; the surrogate block is skipped.
_FIRST_CHAR = 0x100
_SURROGATES = (0xD800, 0xE000)


def byte_alphabet() -> list[str]:
    """The printable character standing for each byte, by byte value.

    Printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b not in others else chr(0x100 + others.index(b)) for b in range(256)]


def byte_ids(special_count: int) -> list[int]:
    """Vocabulary id of each byte: after the special tokens, in order of the printable characters."""
    alphabet = byte_alphabet()
    order = sorted(range(256), key=lambda b: alphabet[b])
    ids = [0] * 256
    for rank, b in enumerate(order):
        ids[b] = special_count + rank
    return ids


def symbol_char(symbol_id: int) -> str:
    code = _FIRST_CHAR + symbol_id
    if code >= _SURROGATES[0]:
        code += _SURROGATES[1] - _SURROGATES[0]
    return chr(code)


def symbol_id(char: str) -> int:
    code = ord(char)
    if code >= _SURROGATES[1]:
        code -= _SURROGATES[1] - _SURROGATES[0]
    return code - _FIRST_CHAR


def symbol_id_of(char: Column) -> Column:
    """:func:`symbol_id` of a byte symbol, all of which lie below the surrogate block."""
    return F.ascii(char) - _FIRST_CHAR


# --- counting ---------------------------------------------------------------------------------


def bpe_words(c: Column) -> Column:
    """Pre-tokens of a text, leading space included."""
    return F.regexp_extract_all(c, F.lit(P.BPE_WORD), F.lit(0))


def bpe_word_counts(df: DataFrame, text: str = "lm_text", line_end: str = "\n") -> DataFrame:
    """``(word, n_uses)`` of the texts as lines of a file, hence with their ``line_end``.

    Map-side aggregation absorbs the frequent words.
    """
    words = bpe_words(F.concat(F.col(text), F.lit(line_end)))
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_uses"))


def word_symbols(word: Column, special_count: int) -> Column:
    """A word as a string of byte symbols."""
    as_bytes = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    ids = byte_ids(special_count)
    # U+0000 cannot be a key of translate, so NUL bytes are shifted out of the way afterwards.
    source = "".join(chr(b) for b in range(1, 256))
    target = "".join(symbol_char(ids[b]) for b in range(1, 256))
    return F.replace(F.translate(as_bytes, source, target), F.lit("\0"), F.lit(symbol_char(ids[0])))


def symbol_table(word_counts: DataFrame, special_count: int) -> DataFrame:
    """``(symbols, n_uses)`` of the words that still have a pair in them."""
    symbols = word_symbols(F.col("word"), special_count).alias("symbols")
    return word_counts.select(symbols, "n_uses").where(F.length("symbols") > 1)


def _pairs(symbols: Column) -> Column:
    """All adjacent symbol pairs: those at even places and those at odd places."""
    two = F.lit("(?s)..")
    odd = F.substring(symbols, 2, 2**31 - 1)
    return F.concat(F.regexp_extract_all(symbols, two, F.lit(0)), F.regexp_extract_all(odd, two, F.lit(0)))


def bpe_pair_counts(symbols: DataFrame, min_frequency: int = 2) -> DataFrame:
    """``(pair, n_uses)`` of adjacent symbols, weighted by word counts, from ``min_frequency`` on."""
    return (
        symbols.select(F.explode(_pairs(F.col("symbols"))).alias("pair"), "n_uses")
        .groupBy("pair")
        .agg(F.sum("n_uses").alias("n_uses"))
        .where(F.col("n_uses") >= min_frequency)
    )


# --- learning ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class BytePairModel:
    """Special tokens and the ordered merges, each a pair of ids; merge ``i`` makes id ``base + i``."""

    special_tokens: tuple[str, ...]
    merges: tuple[tuple[int, int], ...]

    @property
    def first_merge_id(self) -> int:
        return len(self.special_tokens) + 256

    def tokens(self) -> list[str]:
        """Token strings by id."""
        by_id = list(self.special_tokens) + sorted(byte_alphabet())
        for left, right in self.merges:
            by_id.append(by_id[left] + by_id[right])
        return by_id

    def vocab(self, spark: SparkSession) -> DataFrame:
        """``(id, token)``; as long as the vocabulary size, which the caller set."""
        return spark.createDataFrame(list(enumerate(self.tokens())), "id int, token string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        """``(rank, left_id, right_id, left, right)`` in merge order."""
        names = self.tokens()
        rows = [(i, a, b, names[a], names[b]) for i, (a, b) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left_id int, right_id int, left string, right string")

    def save(self, spark: SparkSession, path: str) -> None:
        self.vocab(spark).coalesce(1).write.mode("overwrite").json(f"{path}/vocab")
        self.merge_table(spark).coalesce(1).write.mode("overwrite").json(f"{path}/merges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BytePairModel:
        vocab = spark.read.schema("id int, token string").json(f"{path}/vocab")
        merges = spark.read.schema("rank int, left_id int, right_id int").json(f"{path}/merges").orderBy("rank")
        n_special = vocab.count() - 256 - merges.count()
        special = vocab.where(F.col("id") < n_special).orderBy("id").collect()
        return BytePairModel(
            tuple(r["token"] for r in special), tuple((r["left_id"], r["right_id"]) for r in merges.collect())
        )


# No merge: ranks after every symbol.
_NONE = np.int64(1) << 40


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << 32) | right.astype(np.int64)


def merge_table(merges: Iterable[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Merges ``(left, right, made)`` as sorted keys of the pairs and what each makes; later merges make more."""
    rows = np.array(list(merges), dtype=np.int64).reshape(-1, 3)
    keys = _pair_keys(rows[:, 0], rows[:, 1])
    order = np.argsort(keys)
    return keys[order], rows[order, 2]


def merge_symbols(
    symbols: np.ndarray, lengths: np.ndarray, table: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Many words after the merges of ``table``: in each the earliest first, left to right.

    Words lie one behind the other in ``symbols``, with their ``lengths``; the result has the same form. A step merges
    the earliest pair of every word that still has one, so steps follow the longest word and not the number of words.
    """
    keys, made = table
    n_words, whole = len(lengths), (symbols.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths))
    if not len(keys):
        return whole[0], lengths
    symbols, owner = whole
    finished: list[tuple[np.ndarray, np.ndarray]] = []

    def made_at(at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(symbols) - 1)
        key = _pair_keys(symbols[at], symbols[after])
        slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[slot] == key) & (after > at) & (owner[after] == owner[at]), made[slot], _NONE)

    rank = made_at(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(symbols)])))
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        if (over := least == _NONE).any():
            finished.append((symbols[over], owner[over]))
            symbols, owner, rank, least = (a[~over] for a in (symbols, owner, rank, least))
        at = np.flatnonzero(rank == least)
        # Only a pair of equal symbols overlaps itself: of such a run every other one is merged.
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        at = at[(at - np.repeat(at[run], np.diff(np.append(run, len(at))))) % 2 == 0]
        symbols[at] = least[at]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        at = at - np.arange(len(at))
        around = np.concatenate((at, at[at > 0] - 1))
        rank[around] = made_at(around)
    symbols, owner = (np.concatenate(parts) for parts in zip(*finished)) if finished else whole
    return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n_words)


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words one behind the other, and the lengths of the words."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    return codes.astype(np.int64), np.fromiter(map(len, words), dtype=np.int64, count=len(words))


def merge_words(words: Sequence[str], table: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """:func:`merge_symbols` of strings with one character per symbol."""
    codes, lengths = merge_symbols(*_codes(words), table)
    whole, ends = codes.astype("<u4").tobytes().decode("utf-32-le"), np.cumsum(lengths)
    return [whole[start:end] for start, end in zip((ends - lengths).tolist(), ends.tolist())]


def _character_table(made: Sequence[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    return merge_table((ord(pair[0]), ord(pair[1]), ord(symbol)) for pair, symbol in made)


def merge_word(symbols: str, ranks: dict[str, int], made: Sequence[tuple[str, str]]) -> str:
    """A word after the merges of ``made`` that have a rank, the earliest first, each left to right."""
    return merge_words([symbols], _character_table([made[i] for i in sorted(ranks.values())]))[0]


def _merged(shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _character_table(shared.value)
        for batch in batches:
            words = merge_words(batch.column("symbols").to_pylist(), table)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column("n_uses")], names=["symbols", "n_uses"])

    return of


def stretches(words: Sequence[str], keys: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The stretches of words in which every two neighbours are a pair of the sorted ``keys``, and the place of the
    word that each is from."""
    codes, lengths = _codes(words)
    if len(codes) < 2:
        return [], np.zeros(0, dtype=np.int64)
    key = _pair_keys(codes[:-1], codes[1:])
    joined = np.append(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key, False)
    # A word's last symbol has no neighbour.
    joined[np.cumsum(lengths)[lengths > 0] - 1] = False
    before = np.concatenate(([False], joined[:-1]))
    starts, ends = np.flatnonzero(joined & ~before), np.flatnonzero(~joined & before) + 1
    whole = "".join(words)
    parts = [whole[start:end] for start, end in zip(starts.tolist(), ends.tolist())]
    return parts, np.repeat(np.arange(len(lengths)), lengths)[starts]


def _sorted_keys(pairs: Iterable[str]) -> np.ndarray:
    return np.sort(np.array([ord(pair[0]) << 32 | ord(pair[1]) for pair in pairs], dtype=np.int64))


def fragments(symbols: str, pairs: frozenset[str]) -> list[str]:
    """The stretches of a word in which every two neighbours are one of ``pairs``."""
    return stretches([symbols], _sorted_keys(pairs))[0]


def _fragmented(shared, max_fragments: int):
    """Uses of the stretches of a task. A task that alone finds more than ``max_fragments`` shows that the round has
    too many pairs and looks no further, as its count is not used then."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _sorted_keys(shared.value)
        found: dict[str, int] = {}
        for batch in batches:
            if len(found) > max_fragments:
                continue
            parts, places = stretches(batch.column("symbols").to_pylist(), keys)
            uses = batch.column("n_uses").to_numpy(zero_copy_only=False)[places]
            for part, n in zip(parts, uses.tolist()):
                found[part] = found.get(part, 0) + n
        columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "n_uses"])

    return of


def merge_fragments(parts: Iterable[tuple[str, int]], least: tuple[int, str], room: int, symbol_of: Callable[[int], str]) -> list[tuple[str, str]]:
    """Merge the best pair of ``parts (fragment, uses)`` again and again, as ``(pair, new symbol)`` in order.

    It ends with the first pair that ranks after ``least (uses, pair)``, or when ``room`` merges are made. The
    new symbol of merge ``i`` is ``symbol_of(i)``. Counts are kept up to date from the fragments that hold the
    pair, which an index by pair knows; entries of the queue are corrected when they come up.
    """
    words, uses = [p for p, _ in parts], [n for _, n in parts]
    counts: Counter[str] = Counter()
    places: dict[str, set[int]] = {}
    for at, (word, n) in enumerate(zip(words, uses)):
        for i in range(len(word) - 1):
            counts[word[i : i + 2]] += n
            places.setdefault(word[i : i + 2], set()).add(at)
    heap = [(-n, pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    last = (-least[0], least[1])
    made: list[tuple[str, str]] = []
    while heap and len(made) < room:
        entry = heapq.heappop(heap)
        n, pair = -entry[0], entry[1]
        if counts[pair] != n:
            # Every change of a count brings an entry of its own.
            continue
        if entry > last:
            break
        symbol = symbol_of(len(made))
        made.append((pair, symbol))
        changed: Counter[str] = Counter()
        for at in places.pop(pair):
            word, n = words[at], uses[at]
            if pair not in word:
                continue
            words[at] = after = word.replace(pair, symbol)
            for i in range(len(word) - 1):
                changed[word[i : i + 2]] -= n
            for i in range(len(after) - 1):
                two = after[i : i + 2]
                changed[two] += n
                if symbol in two:
                    places.setdefault(two, set()).add(at)
        for two, change in changed.items():
            if change:
                counts[two] += change
                if counts[two] > 0:
                    heapq.heappush(heap, (-counts[two], two))
    return made


def bpe_learn(
    word_counts: DataFrame,
    vocab_size: int = LanguageModelConfig.vocab_size,
    min_frequency: int = LanguageModelConfig.min_frequency,
    special_tokens: Sequence[str] = SPECIAL_TOKENS,
    max_fragments: int = MAX_FRAGMENTS,
) -> BytePairModel:
    """Learn merges until the vocabulary is full or no pair is frequent enough.

    A round takes the most frequent pairs and cuts every word into the stretches made of them alone. Equal
    stretches are counted together, and on those the driver merges until the best pair ranks after the last
    of the round. This is exact: no pair outside the round ranks before that, nor does a new one that
    takes in a neighbour across a cut, as it is no more frequent than the pair cut and its symbol is newer. How
    many pairs a round takes follows from the stretches they leave: more than ``max_fragments`` never reach the
    driver. Then the words are merged in one pass, without those that have become a single symbol, and the next
    round counts pairs anew. The result is that of one merge per count, equal counts in id order.
    """
    spark = word_counts.sparkSession
    n_special = len(special_tokens)
    first_merge_id = n_special + 256
    merges: list[tuple[int, int]] = []
    # Few bytes but much work per row: one partition per core, whatever the size.
    cores = spark.sparkContext.defaultParallelism
    path = scratch_path(spark, "bpe-words")
    table = materialize(symbol_table(word_counts, n_special).repartition(cores, "symbols"), "bpe-words", path)
    n_pairs = _FIRST_PAIRS
    while first_merge_id + len(merges) < vocab_size:
        counted = materialize(bpe_pair_counts(table, min_frequency), "bpe-pairs")
        while True:
            ranked = counted.orderBy(F.desc("n_uses"), "pair").limit(n_pairs).collect()
            if not ranked:
                break
            chosen = spark.sparkContext.broadcast(frozenset(row["pair"] for row in ranked))
            cut = table.mapInArrow(_fragmented(chosen, max_fragments), "part string, n_uses long")
            parts = materialize(cut.groupBy("part").agg(F.sum("n_uses").alias("n_uses")), "bpe-fragments")
            n_parts = parts.count()
            # A single pair leaves stretches of itself alone.
            if n_parts <= max_fragments or n_pairs == 1:
                break
            # The first round has nothing to go by; a later one is near the number that its forerunner took.
            n_pairs = max(1, n_pairs // (2 if merges else 4))
        if not ranked:
            break
        # A round of all pairs goes down to the least frequent that may be merged.
        least = (ranked[-1]["n_uses"], ranked[-1]["pair"]) if len(ranked) == n_pairs else (min_frequency, chr(0x10FFFF))
        done = first_merge_id + len(merges)
        held = [(row["part"], row["n_uses"]) for row in parts.collect()]
        made = merge_fragments(held, least, vocab_size - done, lambda i: symbol_char(done + i))
        merges += [(symbol_id(pair[0]), symbol_id(pair[1])) for pair, _ in made]
        shared = spark.sparkContext.broadcast(made)
        superseded, path = path, scratch_path(spark, "bpe-words")
        merged = table.mapInArrow(_merged(shared), "symbols string, n_uses long").where(F.length("symbols") > 1)
        # Different words stay different, so there is nothing to count together.
        table = materialize(merged, "bpe-words", path)
        discard(spark, superseded)
        n_pairs *= 4 if n_parts <= max_fragments // 8 else 2 if n_parts <= max_fragments // 3 else 1
    discard(spark, path)
    return BytePairModel(tuple(special_tokens), tuple(merges))


# --- encoding ---------------------------------------------------------------------------------


def encode_words(words: Sequence[str], base: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> pa.ListArray:
    """Ids of each word: the earliest learned pair is merged first, until none is left."""
    texts = [w.encode("utf-8") for w in words]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ids, counts = merge_symbols(base[np.frombuffer(b"".join(texts), dtype=np.uint8)], lengths, table)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


# Words remembered per Python worker; frequent words are encoded once and then looked up.
_WORD_CACHE = 200_000


def _split_special(c: Column, special_tokens: Sequence[str]) -> Column:
    """Cut a text before and after each special token; the pattern only sees texts that hold one."""
    if not special_tokens:
        return F.array(c)
    names = "|".join(r"\Q" + t + r"\E" for t in special_tokens)
    held = reduce(Column.__or__, [F.contains(c, F.lit(t)) for t in special_tokens])
    return F.when(held, F.filter(F.split(c, f"(?={names})|(?<={names})"), lambda p: p != "")).otherwise(F.array(c))


def model_words(c: Column, special_tokens: Sequence[str]) -> Column:
    """Pre-tokens of a text in which special tokens stay whole."""
    special = [str(t) for t in special_tokens]
    return F.flatten(
        F.transform(
            _split_special(c, special),
            lambda piece: F.when(piece.isin(special), F.array(piece)).otherwise(bpe_words(piece)),
        )
    )


def bpe_encode(
    df: DataFrame, model: BytePairModel, text: str = "lm_text", name: str = "ids", max_words: int | None = None
) -> DataFrame:
    """Add the token ids of the whole text, or of its first ``max_words`` words, without boundaries or padding.

    Splitting runs in the JVM; Python only looks words up. The merges travel as a broadcast variable,
    bounded by the vocabulary size. Documents are neither exploded nor shuffled, so a frequent word is
    no hot key.
    """
    shared = df.sparkSession.sparkContext.broadcast(
        (
            {token: i for i, token in enumerate(model.special_tokens)},
            byte_ids(len(model.special_tokens)),
            [(left, right, model.first_merge_id + i) for i, (left, right) in enumerate(model.merges)],
        )
    )

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        special, base, merges = shared.value
        base, table = np.array(base), merge_table(merges)
        # The ids of known words lie in ``store``, special tokens first, which stay whole.
        own = pa.array([[i] for i in special.values()], pa.list_(pa.int32()))
        known, store = {token: at for at, token in enumerate(special)}, own
        for lists in batches:
            # Each distinct word of the batch is encoded once; documents gather the ids by index.
            words = lists.flatten().dictionary_encode()
            distinct = words.dictionary.to_pylist()
            if len(known) > _WORD_CACHE:
                known, store = {token: at for at, token in enumerate(special)}, own
            new = [w for w in distinct if w not in known]
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new))))
                store = pa.concat_arrays([store, encode_words(new, base, table)])
            pieces = store.take(pa.array([known[w] for w in distinct], pa.int64()).take(words.indices))
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))))
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32))
            yield pa.ListArray.from_arrays(offsets, pieces.flatten(), mask=lists.is_null())

    words = model_words(F.col(text), model.special_tokens)
    return df.withColumn(name, encode(words if max_words is None else F.slice(words, 1, max_words)))


def bpe_decode(ids: Column, model: BytePairModel) -> Column:
    """Text of an id array, special tokens as they are written; ids outside the vocabulary are left out."""
    alphabet = byte_alphabet()
    tokens = F.split(F.lit("\u0001".join(model.tokens())), "\u0001")
    joined = F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), "")
    # U+0000 cannot be a target of translate: its character goes first to a byte that no token holds alone.
    others = F.translate(joined, "".join(alphabet[1:]), "".join(chr(b) for b in range(1, 256)))
    return F.decode(F.encode(F.replace(others, F.lit(alphabet[0]), F.lit("\0")), "ISO-8859-1"), "UTF-8")


def encode_examples(
    df: DataFrame, model: BytePairModel, text: str = "lm_text", max_length: int = LanguageModelConfig.max_length
) -> DataFrame:
    """Add fixed-length ``input_ids`` and ``attention_mask`` and drop the text."""
    special = {token: i for i, token in enumerate(model.special_tokens)}
    wrapped = E.add_boundaries(F.col("ids"), special["<s>"], special["</s>"], max_length)
    # Every word gives one id at least, so no later word can matter.
    encoded = bpe_encode(df, model, text, max_words=max_length).withColumn("ids", wrapped)
    return encoded.select(
        *[c for c in df.columns if c != text],
        E.pad_ids(F.col("ids"), max_length, special["<pad>"]).alias("input_ids"),
        E.attention_mask(F.col("ids"), max_length).alias("attention_mask"),
    )
