"""A hidden Markov language model over all documents, trained by Baum-Welch and scored exactly.

The states emit a bounded alphabet: the most frequent words, signs for the rarer words by their last bytes,
and the end of a text. A rare word's own share inside its sign comes from its corpus count, so the alphabet is
bounded while every word of the corpus keeps its own probability. The frequent words are broadcast, which
their number bounds; rare words meet their counts in a join.

Texts are turned into symbols once and written to the shared folder, dealt to blocks by id and text. A pass
goes over all training documents block by block: tasks sum expected counts, one shuffle adds them up by
symbol, and the model is made anew after every block from counts in which older blocks fade. The counts of all
blocks of the last pass together make the final model, so every training symbol counts in it once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import text_bytes, uniform
from docloom.session import materialize

STATES = 8
# Words that the states emit one by one, at most.
HEAD_WORDS = 1 << 16
# Signs of the rarer words, by a checksum of their last bytes.
RARE_SIGNS = 4_096
SIGN_BYTES = 3
# Passes over all training documents, and the blocks that a pass takes one after the other.
PASSES = 2
BLOCKS = 8
# A block's weight among the counts so far is its number, from one, to this power.
FADE = -0.7
ADD = 0.1
# Weight of the corpus-wide distribution in each state's emissions, in tokens.
PRIOR = 20.0
SEED = 5

# Distinct words that a counting task holds, symbols that a training task gathers, and cells of a padded batch.
_FLUSH_WORDS = 400_000
_GATHER = 2_000_000
_CELLS = 1 << 18
# Bands of the histogram of word counts for each doubling.
_BANDS = 64


@dataclass
class Model:
    """Start, transition and emission probabilities (one row per symbol)."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def padded(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of rows of like length, longest first: positions, symbols (row by place) and lengths."""
    lengths = np.array([len(r) for r in rows])
    order, i = np.argsort(-lengths, kind="stable"), 0
    while i < len(order):
        at = order[i : i + max(1, _CELLS // int(lengths[order[i]]))]
        symbols = np.zeros((len(at), lengths[at[0]]), np.int64)
        for j, row in enumerate(at):
            symbols[j, : lengths[row]] = rows[row]
        yield at, symbols, lengths[at]
        i += len(at)


def forward(model: Model, symbols: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """Natural log-likelihood per row by the scaled forward recursion; with ``keep`` also all states and scales."""
    n, width = symbols.shape
    active = np.searchsorted(-lengths, -np.arange(width), side="left")
    log_p = np.zeros(n)
    state, alphas, scales = None, [], []
    for t in range(width):
        m = int(active[t])
        state = (np.broadcast_to(model.start, (m, len(model.start))) if t == 0 else state[:m] @ model.step) * model.emit[symbols[:m, t]]
        scale = state.sum(axis=1)
        state = state / scale[:, None]
        log_p[:m] += np.log(scale)
        if keep:
            alphas.append(state)
            scales.append(scale)
    return (log_p, alphas, scales) if keep else log_p


@dataclass
class Expected:
    """Expected counts of starts, transitions and emissions."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def zero(cls, states: int, symbols: int) -> Expected:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))

    def add(self, model: Model, rows: list[np.ndarray]) -> None:
        """Forward and backward over whole rows."""
        for _, symbols, lengths in padded(rows):
            _, alphas, scales = forward(model, symbols, lengths, keep=True)
            after, seen, share = None, [], []
            for t in range(symbols.shape[1] - 1, -1, -1):
                alpha = alphas[t]
                beta = np.ones_like(alpha)
                if after is not None and len(after):
                    beta[: len(after)] = after @ model.step.T
                    self.step += model.step * (alpha[: len(after)].T @ after)
                gamma = alpha * beta
                seen.append(symbols[: len(alpha), t])
                share.append(gamma)
                after = model.emit[seen[-1]] * beta / scales[t][:, None]
            self.start += share[-1].sum(axis=0)
            places, weights = np.concatenate(seen), np.concatenate(share)
            for k in range(weights.shape[1]):
                self.emit[:, k] += np.bincount(places, weights[:, k], minlength=len(self.emit))

    def mixed(self, other: Expected, share: float) -> Expected:
        """These counts with ``share`` of the sum given to ``other``, scaled to as many symbols."""
        scale = share * self.emit.sum() / other.emit.sum()
        pairs = ((self.start, other.start), (self.step, other.step), (self.emit, other.emit))
        return Expected(*[(1 - share) * a + scale * b for a, b in pairs])

    def plus(self, other: Expected) -> Expected:
        return Expected(self.start + other.start, self.step + other.step, self.emit + other.emit)

    def model(self, base: np.ndarray) -> Model:
        """Probabilities, each state's emissions drawn towards ``base``."""
        step, start = self.step + 1.0, self.start + 1.0
        emit = (self.emit + PRIOR * base[:, None]) / (self.emit.sum(axis=0) + PRIOR)
        return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit)


def start_model(base: np.ndarray, states: int) -> Model:
    """A seeded random model that depends on the alphabet alone."""
    rng = np.random.default_rng(SEED)
    emit = base[:, None] * np.exp(rng.normal(size=(len(base), states)))
    step = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then words ``[^\\x20\\x09-\\x0D]+``."""
    return text.lower().split()


def rare_sign(word: bytes) -> int:
    """The sign of a rarer word; ``_sign`` is the same on a column."""
    return zlib.crc32(word[-SIGN_BYTES:]) % RARE_SIGNS


def _sign(word: str) -> Column:
    last = F.expr(f"substring({word}, greatest(length({word}) - {SIGN_BYTES - 1}, 1), {SIGN_BYTES})")
    return (F.crc32(last) % RARE_SIGNS).cast("int")


def held_out(key: str = "doc_id") -> Column:
    """Documents whose crc32(doc_id as text) is divisible by ten; a null id is the empty text, held out too."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"]
        )

    for batch in batches:
        for body in batch.column("body").to_pylist():
            counts.update(words_of(body))
            if len(counts) >= _FLUSH_WORDS:
                yield flush()
                counts.clear()
    yield flush()


def _symbols(head, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols of every text, its end left out, and the rare words with their number."""
    number, rare = head.value.get, len(head.value)
    for batch in batches:
        n, symbols, words, counts = [], [], [], []
        for body in batch.column("body").to_pylist():
            found = words_of(body)
            ids = [number(w, -1) for w in found]
            tail = Counter([w for w, i in zip(found, ids) if i < 0])
            signs = {w: rare + rare_sign(w) for w in tail}
            ids = [signs[w] if i < 0 else i for w, i in zip(found, ids)]
            n.append(len(found) + 1)
            symbols.append(np.array(ids, np.int32).tobytes())
            words.append(list(tail))
            counts.append(list(tail.values()))
        columns = [batch.column(c) for c in ("uid", "block", "doc_id", "held_out")]
        columns += [pa.array(n, pa.int64()), pa.array(symbols, pa.binary())]
        columns += [pa.array(words, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            columns, names=["uid", "block", "doc_id", "held_out", "n_tokens", "symbols", "rare_words", "rare_counts"]
        )


def _head(counts: DataFrame, most: int) -> list:
    """The most frequent words, by count and then by bytes, at most ``most``.

    Histograms of the counts, first in bands and then inside the band that the bound cuts, give the count of the
    last word taken, so no task and no driver ever ranks the vocabulary. Of the words with that count about as
    many as there is room for are taken, by a hash.
    """
    band = F.floor(F.log2("c") * _BANDS)

    def border(rows: DataFrame, by: Column, room: int) -> tuple[int | None, int]:
        """The group that the bound cuts (None: all fit) and the room left for it."""
        for row in rows.groupBy(by.alias("by")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("by")).collect():
            if row["n"] > room:
                return row["by"], room
            room -= row["n"]
        return None, room

    cut_band, room = border(counts, band, most)
    if cut_band is None:
        taken = counts
    else:
        cut, room = border(counts.where(band == cut_band), F.col("c"), room)
        ties = counts.where(F.col("c") == cut)
        taken = counts.where(F.col("c") > cut).union(ties.where(uniform("word", seed=SEED) < room / ties.count()))
    return sorted(taken.collect(), key=lambda r: (-r["c"], bytes(r["word"])))[:most]


def _with_end(symbols: Iterable[bytes], end: int) -> list[np.ndarray]:
    return [np.append(np.frombuffer(s, np.int32), end) for s in symbols]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together up to a bounded number of symbols, so that rows of like length can be padded."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("symbols").nbytes // 4
        if size >= _GATHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _expectation(model, end: int) -> Callable:
    """A task's expected counts as one row per symbol; transitions and starts under negative symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = len(model.value.start)
        total = Expected.zero(states, end + 1)
        for held in _gathered(batches):
            total.add(model.value, _with_end((s for b in held for s in b.column("symbols").to_pylist()), end))
        used = np.flatnonzero(total.emit.any(axis=1))
        values = np.concatenate([total.emit[used], total.step, total.start[None, :]])
        names = np.concatenate([used, -1 - np.arange(states), [-1 - states]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names.astype(np.int32)), *[pa.array(values[:, k]) for k in range(states)]],
            names=["symbol", *[f"e{k}" for k in range(states)]],
        )

    return run


def expected_counts(symbols: DataFrame, model: Model, end: int) -> Expected:
    """Expected counts of all rows of ``symbols``; at most one row per symbol and state reaches the driver."""
    states = len(model.start)
    shared = symbols.sparkSession.sparkContext.broadcast(model)
    columns = [f"e{k}" for k in range(states)]
    schema = "symbol int, " + ", ".join(f"{c} double" for c in columns)
    counted = symbols.select("symbols").mapInArrow(_expectation(shared, end), schema)
    rows = counted.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    shared.unpersist()
    names, values = rows["symbol"].to_numpy(), rows[columns].to_numpy()
    total = Expected.zero(states, end + 1)
    total.emit[names[names >= 0]] = values[names >= 0]
    for name, value in zip(names[names < 0], values[names < 0]):
        if name == -1 - states:
            total.start = value
        else:
            total.step[-1 - name] += value
    return total


def baum_welch(symbols: DataFrame, base: np.ndarray, states: int, passes: int, blocks: int) -> Model:
    """Passes over all rows of ``symbols``, block by block; without rows or passes the start model."""
    model, counts, end = start_model(base, states), None, len(base) - 1
    n = 0
    for _ in range(passes):
        total = None
        for block in range(blocks):
            found = expected_counts(symbols.where(F.col("block") == block), model, end)
            if not found.emit.any():
                continue
            n += 1
            counts = found if counts is None else counts.mixed(found, n**FADE)
            total = found if total is None else total.plus(found)
            model = counts.model(base)
        if total is None:
            break
        # The next pass goes on from the faded counts; the last one ends with those of all its blocks.
        final = total.model(base)
    return final if n else model


def _scores(model, log_base: np.ndarray, log_mass: np.ndarray, rare: int) -> Callable:
    end = len(log_base) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            batch = pa.Table.from_batches(held)
            rows = _with_end(batch.column("symbols").to_pylist(), end)
            score = np.zeros(len(rows))
            for at, symbols, lengths in padded(rows):
                score[at] = forward(model.value, symbols, lengths) / np.log(10)
            base = [float(log_base[r].sum()) for r in rows]
            # A rare word's share of its sign: the join below brings the word's part, this is the sign's.
            score -= [float(log_mass[r].sum()) for r in rows]
            known = [int((r < rare).sum()) for r in rows]
            kept = [batch.column(c).combine_chunks() for c in ("uid", "doc_id", "held_out", "n_tokens")]
            table = pa.Table.from_arrays(
                [*kept, pa.array(score), pa.array(base, pa.float64()), pa.array(known, pa.int64())],
                names=["uid", "doc_id", "held_out", "n_tokens", "state_score", "head_base", "head_known"],
            )
            yield from table.to_batches()

    return run


def lm_scores(docs: DataFrame, states: int = STATES, head_words: int = HEAD_WORDS, passes: int = PASSES, blocks: int = BLOCKS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))), ``score`` the model's
    log10 probability of the whole text, its end included. Documents with held_out teach nothing. Null and
    empty texts are an end alone. Repeated rows are each scored (and learned from); without training
    documents every token is unknown. Blocks follow from id and text, so scores do not depend on how rows are dealt
    to partitions, up to rounding. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", held_out().alias("held_out"), text_bytes().alias("body"))
    train = given.where(~F.col("held_out"))
    counted = train.select("body").mapInArrow(_count, "word binary, c long")
    counts = materialize(counted.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    n_docs = train.select("held_out").count()
    sums = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    top = _head(counts, head_words)
    head = spark.sparkContext.broadcast({bytes(r["word"]): i for i, r in enumerate(top)})
    rare, end = len(top), len(top) + RARE_SIGNS

    head_counts = np.array([r["c"] for r in top], float)
    # A sign's mass: that of its words which are not in the head, and of one unknown word.
    sign_mass = np.full(RARE_SIGNS, ADD)
    for r in counts.groupBy(_sign("word").alias("sign")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        sign_mass[r["sign"]] += r["c"] + ADD * r["v"]
    np.subtract.at(sign_mass, np.array([rare_sign(bytes(r["word"])) for r in top], int), head_counts + ADD)
    sign_mass = np.maximum(sign_mass, ADD)
    mass = np.concatenate([head_counts + ADD, sign_mass, [n_docs + ADD]])
    base = mass / mass.sum()
    whole = n + ADD * (v + 1)
    # Signs add nothing here: rare words bring their own share.
    log_base = np.log10(mass / whole)
    log_base[rare:end] = 0.0
    log_mass = np.zeros(end + 1)
    log_mass[rare:end] = np.log10(sign_mass)

    block = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "body"), F.lit(blocks)).cast("int")
    placed = given.select(F.monotonically_increasing_id().alias("uid"), block.alias("block"), "doc_id", "held_out", "body")
    schema = placed.select(
        "uid",
        "block",
        "doc_id",
        "held_out",
        F.lit(0).cast("long").alias("n_tokens"),
        F.col("body").alias("symbols"),
        F.array().cast("array<binary>").alias("rare_words"),
        F.array().cast("array<bigint>").alias("rare_counts"),
    ).schema
    encoded = materialize(placed.mapInArrow(lambda batches: _symbols(head, batches), schema), "symbols", by="block")
    model = baum_welch(encoded.where(~F.col("held_out")), base, states, passes if n_docs else 0, blocks)

    shared = spark.sparkContext.broadcast(model)
    narrow = encoded.select("uid", "doc_id", "held_out", "n_tokens", "symbols")
    real = F.lit(0.0)
    out = narrow.select(
        "uid", "doc_id", "held_out", "n_tokens", real.alias("state_score"), real.alias("head_base"), F.lit(0).cast("long").alias("head_known")
    ).schema
    scored = narrow.mapInArrow(_scores(shared, log_base, log_mass, rare), out)

    pairs = F.explode(F.arrays_zip("rare_words", "rare_counts")).alias("pair")
    tail = encoded.select("uid", pairs).select("uid", F.col("pair.rare_words").alias("word"), F.col("pair.rare_counts").alias("times"))
    met = tail.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums_of_rare = met.groupBy(F.col("uid").alias("rare_uid")).agg(
        F.sum("times").alias("rare_tokens"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(c + F.lit(ADD))).alias("rare_log"),
    )
    joined = scored.join(sums_of_rare, F.col("uid") == F.col("rare_uid"), "left")
    zero = F.lit(0)
    tokens, log = F.coalesce("rare_tokens", zero), F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", zero) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_base") + log - tokens * F.lit(float(np.log10(whole)))).alias("base_score"),
        (F.col("state_score") + log).alias("score"),
    )
