"""Interleaved block split, split sizes and size-capped subsets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import SplitConfig
from docloom.operators.row_index import global_row_index

_RATIO_TOLERANCE = 1e-9
# Blocks up to which a split is a chain of conditions over the block ends; beyond, a search in their array.
MAX_CUT_BLOCKS = 300
# Subset size up to which the keys are ranked by a top-k, whose result one task merges.
_TOP_K = 100_000


def check_ratios(config: SplitConfig) -> None:
    total = config.dev + config.test + config.train
    if abs(total - 1.0) > _RATIO_TOLERANCE:
        raise ValueError(f"dev + test + train must be 1.0, got {total}")
    if config.parts < 1:
        raise ValueError(f"parts must be at least 1, got {config.parts}")


def _block_sizes(n: int, config: SplitConfig) -> list[tuple[str, int]]:
    """Rows of the train, test and dev block of one part, rounded half to even."""
    ratios = (("train", config.train), ("test", config.test), ("dev", config.dev))
    return [(split, round(n * (ratio / config.parts))) for split, ratio in ratios]


def block_bounds(n: int, config: SplitConfig = SplitConfig()) -> list[tuple[str, int]]:
    """Consecutive blocks as ``(split, exclusive end)``; the last block ends at ``n``.

    Each part gives a train, a test and a dev block of half-even rounded size. Ends are clamped to
    ``n``, and rows after the last part go to train.
    """
    check_ratios(config)
    per_part = _block_sizes(n, config)
    bounds: list[tuple[str, int]] = []
    end = 0
    for _ in range(config.parts):
        for split, size in per_part:
            end = min(n, end + size)
            bounds.append((split, end))
    if end < n:
        bounds.append(("train", n))
    return bounds


def split_by_row_index(
    df: DataFrame, config: SplitConfig = SplitConfig(), n: int | None = None, row_idx: str = "row_idx"
) -> DataFrame:
    """Add ``split`` to rows that already carry a dense 0-based index; no shuffle.

    The block follows from the place inside the part, so the number of parts costs nothing.
    """
    check_ratios(config)
    (_, train), (_, test), (_, dev) = _block_sizes(df.count() if n is None else n, config)
    per_part = train + test + dev
    if per_part == 0:
        return df.withColumn("split", F.lit("train"))
    position = F.col(row_idx)
    place = position % per_part
    split = (
        F.when((position >= per_part * config.parts) | (place < train), F.lit("train"))
        .when(place < train + test, F.lit("test"))
        .otherwise(F.lit("dev"))
    )
    return df.withColumn("split", split)


@dataclass(frozen=True)
class SplitCuts:
    """A split as cut keys: each block holds the keys up to and including its last key.

    Applying it is a projection, so texts are never shuffled for it.
    """

    order_by: tuple[str, ...]
    blocks: tuple[tuple[str, tuple], ...]

    def _up_to(self, key: tuple) -> Column:
        if len(self.order_by) == 1:
            return F.col(self.order_by[0]) <= F.lit(key[0])
        return F.struct(*self.order_by) <= F.struct(*[F.lit(v).alias(c) for c, v in zip(self.order_by, key)])

    def column(self) -> Column:
        if len(self.blocks) <= MAX_CUT_BLOCKS:
            return _first_block(self.blocks, self._up_to)
        # Many blocks: the block of a row is the number of blocks that end before it.
        key = F.col(self.order_by[0]) if len(self.order_by) == 1 else F.struct(*self.order_by)
        ends = [F.lit(k[0]) if len(k) == 1 else F.struct(*[F.lit(v).alias(c) for c, v in zip(self.order_by, k)]) for _, k in self.blocks]
        names = F.array(*[F.lit(name) for name, _ in self.blocks])
        passed = F.size(F.filter(F.array(*ends[:-1]), lambda end: end < key))
        return F.get(names, passed)

    def predicate(self, split: str) -> Column:
        """Rows of one split as key ranges, which a Parquet scan can use to skip row groups."""
        chosen = F.lit(False)
        for i, (name, key) in enumerate(self.blocks):
            if name == split:
                block = self._up_to(key)
                chosen = chosen | (block & ~self._up_to(self.blocks[i - 1][1]) if i else block)
        return chosen


def _first_block(blocks: Sequence[tuple[str, object]], reaches) -> Column:
    """The name of the first block whose end the row does not exceed."""
    if not blocks:
        return F.lit(None).cast("string")
    if len(blocks) == 1:
        return F.lit(blocks[0][0])
    column = F
    for name, end in blocks[:-1]:
        column = column.when(reaches(end), F.lit(name))
    # The last block needs no condition: it takes whatever is left.
    return column.otherwise(F.lit(blocks[-1][0]))


def split_cuts(
    df: DataFrame, order_by: str | Sequence[str], config: SplitConfig = SplitConfig()
) -> SplitCuts:
    """Find the last key of every block from the key columns alone.

    The keys are numbered and the few at block ends are collected: at most ``3 * parts + 1`` rows. A null or
    repeated key is an error, as its rows would have no place of their own.
    """
    columns = (order_by,) if isinstance(order_by, str) else tuple(order_by)
    check_ratios(config)
    keys = global_row_index(df.select(*columns), columns)
    n = keys.count()
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    odd = keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | absent).first()
    if odd is not None:
        raise ValueError(f"keys must be unique and not null, got {[odd[c] for c in columns]} in {odd['n_rows']} rows")
    blocks: list[tuple[str, int]] = []
    for name, end in block_bounds(n, config):
        if end > (blocks[-1][1] if blocks else 0):
            blocks.append((name, end))
    last = [end - 1 for _, end in blocks]
    found = {row["row_idx"]: tuple(row[c] for c in columns) for row in keys.where(F.col("row_idx").isin(last)).collect()}
    return SplitCuts(columns, tuple((name, found[end - 1]) for name, end in blocks))


def block_split(
    df: DataFrame, order_by: str | Sequence[str], config: SplitConfig = SplitConfig()
) -> DataFrame:
    """Add ``split`` (train, test or dev) by position in the order of the unique, non-null ``order_by``.

    Rows are never joined or shuffled for it, whatever the number of parts.
    """
    return df.withColumn("split", split_cuts(df, order_by, config).column())


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def size_capped_subset(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """``k`` rows in the order of a seeded hash of the unique ``key``.

    Only the keys are ranked; the rows are then taken by comparing with the last ranked key.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    keys = df.select(rank.alias("_rank"), F.col(key).alias("_key"))
    if k <= _TOP_K:
        ranked = keys.orderBy("_rank", "_key").limit(k)
    else:
        ranked = global_row_index(keys, ["_rank", "_key"]).where(F.col("row_idx") < k)
    last = ranked.agg(F.max(F.struct("_rank", "_key")).alias("last")).first()["last"]
    if last is None:
        return df
    within = (rank < last["_rank"]) | ((rank == last["_rank"]) & (F.col(key) <= F.lit(last["_key"])))
    return df.where(within)
